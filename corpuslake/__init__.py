"""corpuslake: a PySpark-native engine for corpora of long technical documents."""
