"""Error-bounded track analytics on Spark: plain DataFrame plans for quantizing, ordering, packing and replaying point tracks."""
