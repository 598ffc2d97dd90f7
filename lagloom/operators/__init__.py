"""lagloom.operators"""
