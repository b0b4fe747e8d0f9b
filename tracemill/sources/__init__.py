"""tracemill.sources"""
