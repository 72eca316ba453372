"""Analytics on code, SQL-workload and ownership data, written as Spark DataFrame plans."""
