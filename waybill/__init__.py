"""waybill: delivery-operations analytics on Spark DataFrames."""
