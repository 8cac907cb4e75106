"""Names below a path and small files, through the cluster's file system.

PySpark has no public way to it, so this is the one place that reaches into the JVM.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when the path, which may be a glob, matches something."""
    hadoop_path, fs = _file_system(spark, path)
    return bool(fs.globStatus(hadoop_path))


def matching_names(spark: SparkSession, pattern: str) -> list[str]:
    """Names that match a glob, in order."""
    hadoop_path, fs = _file_system(spark, pattern)
    return sorted(str(s.getPath().getName()) for s in fs.globStatus(hadoop_path) or [])


def publish_file(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content; False, and no change, if there is one already.

    The file is written under another name and renamed without overwriting, which HDFS does in
    one step; a store without such a rename must not be written by runs at the same time.
    """
    hadoop_path, fs = _file_system(spark, path)
    target = fs.makeQualified(hadoop_path)
    draft, _ = _file_system(spark, f"{target.getParent()}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        context.rename(draft, target, no_options)
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def finished_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the sub-folders whose write was completed, in order."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(root, "*/_SUCCESS")
    _, fs = _file_system(spark, root)
    return sorted(str(s.getPath().getParent().getName()) for s in fs.globStatus(marker) or [])


def delete_folder(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _file_system(spark, path)
    fs.delete(hadoop_path, True)
