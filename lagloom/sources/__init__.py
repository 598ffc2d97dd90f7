"""lagloom.sources"""
