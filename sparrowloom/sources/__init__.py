"""sparrowloom.sources"""
