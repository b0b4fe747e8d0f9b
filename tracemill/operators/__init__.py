"""tracemill.operators"""
