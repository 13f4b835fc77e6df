"""varietas — corpus diversity and similarity analytics on Spark DataFrames.

Every operator is a plain ``DataFrame -> DataFrame`` function (usable with
``df.transform``).  Text cleaning, tokenisation and all pair scores are
built-in Spark SQL expressions; Python only runs where Spark has no
function for the job (gzip in the compression ratio).
"""

from varietas.session import ensure_checkpoint_dir, get_spark

__all__ = ["get_spark", "ensure_checkpoint_dir"]
