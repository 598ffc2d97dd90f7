"""lagloom: lead-lag analytics over panels of time series, on Spark."""
