"""tracemill.functions"""
