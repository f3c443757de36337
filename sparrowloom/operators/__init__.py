"""sparrowloom.operators"""
