"""ampmill.plans"""
