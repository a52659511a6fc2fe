"""A catalogue in versions, with writers that notice each other.

A version is a manifest: for each category the folder that holds its rows and the version that wrote it. A writer names
the version that it read; its rows are written first, then the next manifest appears by a rename that fails if another
writer was faster. It then reads again, leaves out the categories that changed meanwhile, and tries the next number.
Readers see a whole version, and a writer that ends before the rename has changed nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Version:
    """``categories``: each (or null) with the folder of its rows and the version that wrote them. Number 0 is the empty catalogue."""

    number: int = 0
    categories: dict = field(default_factory=dict)


class Manifests:
    """The manifests of a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.base = spark, folder.rstrip("/")
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.files = self._path("versions").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.fs.Path(f"{self.base}/{name}")

    def last(self) -> int:
        """The number of the newest version; what writers that ended have left beside the manifests is passed over."""
        if not self.files.exists(self._path("versions")):
            return 0
        names = [str(s.getPath().getName()) for s in self.files.listStatus(self._path("versions"))]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def read(self, number: int) -> Version:
        if number == 0:
            return Version()
        stream = self.files.open(self._path(f"versions/{number:012d}"))
        try:
            rows = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Version(number, {name: (place, by) for name, place, by in rows})

    def create(self, version: Version) -> bool:
        """Whether this manifest is the first of its number: it is written beside them and renamed, never over another."""
        beside, place = self._path(f"versions/.new-{uuid.uuid4().hex}"), self._path(f"versions/{version.number:012d}")
        stream = self.files.create(beside, False)
        stream.write(bytearray(json.dumps([[k, *v] for k, v in version.categories.items()]).encode()))
        stream.close()
        rename = getattr(self.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self.fs.FileContext.getFileContext(place.toUri(), self.conf).rename(beside, place, how)
        except Py4JJavaError as error:
            self.files.delete(beside, False)
            if str(error.java_exception.getClass().getName()).endswith("FileAlreadyExistsException"):
                return False
            raise
        return True


def current_version(spark: SparkSession, folder: str) -> Version:
    found = Manifests(spark, folder)
    return found.read(found.last())


def read_version(spark: SparkSession, folder: str, number: int | None = None, category: str = "category") -> DataFrame:
    """The rows of a version, the newest by default; the empty catalogue raises, as it has no columns."""
    found = Manifests(spark, folder)
    version = found.read(found.last() if number is None else number)
    if not version.categories:
        raise ValueError("the catalogue is empty")
    parts = None
    for place in sorted({p for p, _ in version.categories.values()}):
        own = [k for k, (p, _) in version.categories.items() if p == place]
        name = F.col(f"`{category}`").cast("string")
        wanted = F.when(name.isNull(), F.lit(None in own)).otherwise(name.isin([k for k in own if k is not None]))
        rows = spark.read.parquet(f"{found.base}/{place}").where(wanted)
        parts = rows if parts is None else parts.unionByName(rows, allowMissingColumns=True)
    return parts


def commit(rows: DataFrame, folder: str, read: Version, category: str = "category", replaced: list | None = None) -> tuple[Version, list]:
    """Replace categories by ``rows``; ``read`` is the version that they were made from. Returns the version that holds them and the categories that were left out.

    ``replaced`` names the categories that are replaced, by default those of the rows; one without rows becomes empty,
    and rows of others stay unseen. A category that another writer changed after ``read`` is left out, whoever is
    right: its newer rows stay. If all are left out, or there are none, no version is made. A null category is one. All
    categories are listed in each manifest, so their number has to be small; the rows of one may be many.
    """
    spark = rows.sparkSession
    found = Manifests(spark, folder)
    place = f"data/{uuid.uuid4().hex}"
    rows.sortWithinPartitions(f"`{category}`").write.parquet(f"{found.base}/{place}")
    if replaced is None:
        held = spark.read.parquet(f"{found.base}/{place}")
        replaced = [r[0] for r in held.select(F.col(f"`{category}`").cast("string")).distinct().collect()]
    while True:
        now = found.read(found.last())
        own = [k for k in replaced if now.categories.get(k) == read.categories.get(k)]
        if own:
            new = Version(now.number + 1, {**now.categories, **dict.fromkeys(own, (place, now.number + 1))})
            if not found.create(new):
                continue  # another writer was faster
            now = new
        return now, [k for k in replaced if k not in own]
