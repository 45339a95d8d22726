"""sparkloom: catalogue and interaction analytics on Spark DataFrames."""
