"""sparrowloom.functions"""
