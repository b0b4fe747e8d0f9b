"""tracemill: conversation-log analytics and judge reliability statistics on Spark."""
