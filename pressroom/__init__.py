"""pressroom: a Spark-native engine that builds and measures news-article corpora.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
built-ins, joins, aggregates and windows.  Sub-packages:

* ``sources``   - readers (driver tables, article JSON lines, WARC, rule files)
* ``sinks``     - writers (articles, cleaned sites, splits, statistics, metrics)
* ``functions`` - column expressions (text, URL, date, id helpers)
* ``operators`` - relational operators (clean, dedup, split, stats, HTML, ROUGE, ...)
* ``plans``     - end-to-end compositions of operators (scrape, clean, dedup, report)
* ``streaming`` - the stateless extract stage under Structured Streaming
"""

from pressroom.config import Config

__all__ = ["Config"]
