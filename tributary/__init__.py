"""PySpark-native analytics over control-flow graphs, programs and their traces."""
