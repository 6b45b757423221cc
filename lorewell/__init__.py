"""Knowledge extraction and entity resolution over article collections, as Spark DataFrame plans."""
