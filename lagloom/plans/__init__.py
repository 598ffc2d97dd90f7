"""lagloom.plans"""
