"""lumenframe: medical-imaging (DICOM) data as Spark DataFrames."""
