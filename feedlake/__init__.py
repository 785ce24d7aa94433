"""feedlake: feed payloads -> typed item tables -> rendered Markdown digests, on Spark.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``) function
built from Spark's built-in expressions, so Catalyst can prune, push down and
code-generate the whole plan.
"""

__version__ = "0.1.0"
