"""tracemill.sinks"""
