"""ampmill.sources"""
