"""lexweave: a Spark-native text modelling and correction engine; every model is a set of DataFrames."""
