"""termforge: text retrieval, crawl analytics and corpus preparation on the Spark DataFrame API."""

__version__ = "0.1.0"
