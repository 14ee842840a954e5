"""Daily-bar analytics on Spark: history, features, labels, scores, orders and trade evaluation.

Every public function takes and returns DataFrames, so pipelines compose with ``df.transform``.
"""
