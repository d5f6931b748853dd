"""New folders in the shared folder for tables that cut lineage or hold stream state."""

import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import SparkSession

from moodquarry.plans.session import shared_folder

REMOVERS = 16  # paths removed at a time


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def from_url(spark: SparkSession, url: str) -> str:
    """The path that a URL, as in `_metadata.file_path`, stands for; folder names keep the escapes that Spark gave them."""
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(url)).toString()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder with all it holds, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def remove_all(spark: SparkSession, paths: Iterable[str]) -> None:
    """`remove` for many paths of one store, some at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path, stores = jvm.org.apache.hadoop.fs.Path, []

    def one(name: str) -> None:
        place = path(name)
        if not stores:
            stores.append(place.getFileSystem(conf))
        stores[0].delete(place, True)

    names = iter(paths)
    with ThreadPoolExecutor(REMOVERS) as pool:
        while some := list(islice(names, 1000)):  # the names come from a table, a part at a time
            list(pool.map(one, some))


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Give a complete folder its place, whose parents are made; a place that is taken is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path(new).getParent())
    if store.exists(path(new)) or not store.rename(path(old), path(new)):
        raise FileExistsError(new)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, none if it is not there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(place)) if store.exists(place) else []


def make_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
