"""Networks of tensors: topology on the driver, payload in DataFrames."""
