"""ampmill.operators"""
