"""codelabels: label the programming skills shown by each changed source file.

Every public function maps DataFrames to DataFrames or Columns to Columns, so
Spark plans, partitions and spills the work; nothing is gathered on the driver.
"""
