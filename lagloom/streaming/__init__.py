"""lagloom.streaming"""
