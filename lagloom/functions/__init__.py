"""lagloom.functions"""
