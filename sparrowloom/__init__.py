"""sparrowloom: Spark jobs that prepare and analyse multimodal training data."""
