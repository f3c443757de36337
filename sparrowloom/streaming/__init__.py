"""sparrowloom.streaming"""
