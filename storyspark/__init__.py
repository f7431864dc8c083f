"""storyspark: ranked, de-duplicated stories out of large article streams, on Spark DataFrames."""
