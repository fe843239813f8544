"""ampmill.streaming"""
