"""A dataset: a folder of Parquet tables named like obs, var, X, layers/counts, obsm/action, obsp/network, and its notes.

Tables are replaced by writing a new version and then an index of the next number, moved into place whole; readers
take the index of the largest number, so they never see half a table and a lost writer leaves the old one in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that the library adds to annotations.
RESERVED = ("pos", "name", "cell", "gene")
KINDS = ("obs", "var", "X", "layers", "obsm", "varm", "obsp", "varp")


class Dataset:
    """Named tables in ``path``; with ``auto_persist`` off, updates wait for ``checkpoint``."""

    def __init__(self, spark: SparkSession, path: str, auto_persist: bool = True):
        self.spark, self.path, self.auto_persist = spark, path.rstrip("/"), auto_persist
        self.waiting: dict[str, DataFrame] = {}
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.number = max(self._numbers(), default=0)
        self.index: dict = json.loads(self._read(f"index-{self.number}.json") or '{"tables": {}, "uns": {}}')

    def _numbers(self) -> list[int]:
        """Numbers of the indexes in place."""
        folder = self._fs_path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return [int(n[6:-5]) for n in names if n.startswith("index-") and n.endswith(".json")]

    def _read(self, name: str) -> str | None:
        p = self._fs_path(f"{self.path}/{name}")
        if not self._fs.exists(p):
            return None
        return "\n".join(r.value for r in self.spark.read.option("wholetext", True).text(f"{self.path}/{name}").collect())

    def _commit(self) -> None:
        """The next index; another writer that took its number is an error, and the index of this one stays as it was."""
        temp, to = self._fs_path(f"{self.path}/_index-{uuid.uuid4().hex}"), self._fs_path(f"{self.path}/index-{self.number + 1}.json")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(self.index, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(temp, to):
            self._fs.delete(temp, False)
            raise RuntimeError("another writer has changed the dataset")
        self.number += 1
        for old in self._numbers():
            if old < self.number - 1:  # readers may still hold the last one
                self._fs.delete(self._fs_path(f"{self.path}/index-{old}.json"), False)

    def names(self) -> list[str]:
        return sorted({*self.index["tables"], *self.waiting})

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.waiting:
            return self.waiting[name]
        if name not in self.index["tables"]:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/{self.index['tables'][name]}")

    def put(self, uns: dict | None = None, validate: bool = False, **tables: DataFrame) -> None:
        """Update tables (``obsm__action`` is obsm/action) and notes; null notes are left out."""
        for key, df in tables.items():
            name = key.replace("__", "/")
            if name.split("/")[0] not in KINDS:
                raise ValueError(f"unknown kind of table {name!r}")
            if validate:
                check_finite(df, name)
            self.waiting[name] = df
        self.index["uns"].update({k: v for k, v in (uns or {}).items() if v is not None})
        if self.auto_persist:
            self.checkpoint()

    def checkpoint(self) -> list[str]:
        """Write what waits; the names written."""
        done = sorted(self.waiting)
        for name in done:
            version = f"{name}-{uuid.uuid4().hex}.parquet"
            self.waiting[name].write.parquet(f"{self.path}/{version}")
            self.index["tables"][name] = version
        self.waiting.clear()
        self._commit()
        return done

    def compact(self, names: list[str] | None = None, file_bytes: int = 256 << 20, codec: str | None = None) -> None:
        """Rewrite tables in files of about ``file_bytes``, on request with another codec ('none': uncompressed)."""
        for name in names or sorted(self.index["tables"]):
            old = self.index["tables"][name]
            size = self._fs.getContentSummary(self._fs_path(f"{self.path}/{old}")).getLength()
            version = f"{name}-{uuid.uuid4().hex}.parquet"
            table = self[name].repartition(max(1, -(-size // file_bytes)))
            writer = table.write if codec is None else table.write.option("compression", codec)
            writer.parquet(f"{self.path}/{version}")
            self.index["tables"][name] = version
        self._commit()

    def storage(self) -> DataFrame:
        """(name, files, bytes, codec) of the written tables; the codec is the one in the files' names."""
        rows = []
        for name, version in sorted(self.index["tables"].items()):
            files = [f for f in self._fs.listStatus(self._fs_path(f"{self.path}/{version}")) if f.getPath().getName().startswith("part-")]
            codecs = {p[-2] if len(p := f.getPath().getName().split(".")) > 2 else "none" for f in files}
            rows.append((name, len(files), sum(f.getLen() for f in files), ",".join(sorted(codecs))))
        return self.spark.createDataFrame(rows, "name string, files int, bytes long, codec string")

    def subset(self, cells: DataFrame | None = None, genes: DataFrame | None = None) -> None:
        """Keep the given cells and genes only, in one step for all tables; nothing left is an error."""
        kept = self._kept(cells, genes)
        self.waiting.update(kept)
        self.checkpoint()

    def _kept(self, cells: DataFrame | None, genes: DataFrame | None) -> dict[str, DataFrame]:
        out = {}
        for name in self.names():
            df = self[name]
            for keep, key, pair in ((cells, "cell", "obsp"), (genes, "gene", "varp")):
                if keep is None:
                    continue
                for c in ("src", "dst") if name.startswith(pair) else (key,) if key in df.columns else ():
                    df = df.join(keep.select(F.col(key).alias(c)), c, "left_semi")
            if name in ("obs", "var") and not df.limit(1).count():
                raise ValueError(f"no rows of {name} are left")
            out[name] = df
        return out

    def materialize(self, path: str, cells: DataFrame | None = None, genes: DataFrame | None = None) -> "Dataset":
        """A standalone copy in ``path``, of the given cells and genes only; nothing left is an error."""
        out = Dataset(self.spark, path, auto_persist=False)
        out.waiting.update(self._kept(cells, genes))
        out.index["uns"] = dict(self.index["uns"])
        out.checkpoint()
        return out


def check_finite(df: DataFrame, name: str) -> None:
    """Error if a number of ``df`` is NaN or infinite."""
    bad = [F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c, t in df.dtypes if t in ("double", "float")]
    found = df.agg(*bad).first().asDict() if bad else {}
    wrong = sorted(c for c, n in found.items() if n)
    if wrong:
        raise ValueError(f"{name}: NaN or infinite values in {', '.join(wrong)}")


def check_pairs(g: DataFrame, axis: DataFrame, key: str) -> None:
    """Error if an end of (src, dst, weight) is not on the axis (key)."""
    ends = g.select(F.col("src").alias(key)).union(g.select("dst")).distinct()
    if ends.join(axis.select(key), key, "left_anti").limit(1).count():
        raise ValueError(f"an edge ends outside the {key}s")


def check_rows(df: DataFrame, axis: DataFrame, key: str, name: str) -> None:
    """Error if ``df`` has not one row for each member of the axis."""
    n, found = axis.count(), df.select(key).join(axis.select(key), key, "left_semi")
    if (df.count(), found.distinct().count()) != (n, n):
        raise ValueError(f"{name} has not one row for each {key}")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) in the file's order; positions from 0."""
    from sparkmat.operators.network import numbered

    t = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return numbered(t, "b", "i", name="pos").select("pos", "line")


def read_annotations(spark: SparkSession, path: str, headers: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """(pos, columns as text, name): the name is the first column, repeats get _1, _2, ...

    A header that is one of our own column names, in any case, gets the ending _label.
    """
    from sparkmat.operators.matrix import unique_names

    t = _lines(spark, path).select("pos", F.split("line", f"\\Q{sep}\\E").alias("c"))
    width = t.agg(F.max(F.size("c"))).first()[0] or 1
    headers = headers or [f"V{i + 1}" for i in range(width)]
    if len(headers) != width:
        raise ValueError(f"{len(headers)} headers for {width} columns")
    headers = [f"{h}_label" if h.lower() in RESERVED else h for h in headers]
    t = t.select("pos", *(F.get("c", F.lit(i)).alias(h) for i, h in enumerate(headers)))
    return t.join(unique_names(t.select("pos", F.col(headers[0]).alias("name"))).withColumnRenamed("unique_name", "name"), "pos")


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """A genes x cells coordinate file as (cell, gene, value), from 0, and its numbers of genes and cells.

    Coordinates stand in every line, so the file is read in any order and split freely.
    """
    t = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("c"))
    size = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != "")).first()[0].split()
    rows = t.where(F.size("c") == 3)
    size_line = (F.col("c")[0] == size[0]) & (F.col("c")[1] == size[1]) & (F.col("c")[2] == size[2])
    entry = lambda r: r.select((F.col("c")[1].cast("long") - 1).alias("cell"), (F.col("c")[0].cast("long") - 1).alias("gene"), F.col("c")[2].cast("double").alias("value"))
    x, same = entry(rows.where(~size_line)), rows.where(size_line)
    # The last entry can be spelt like the size line; then one of the two stays.
    more = same.count() - 1
    return (x.unionByName(entry(same).limit(more)) if more else x), int(size[0]), int(size[1])


def import_matrix(spark: SparkSession, folder: str, mtx: str, genes: str, cells: str, gene_headers: list[str] | None = None, cell_headers: list[str] | None = None, sep: str = "\t") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(X, obs, var) of a MatrixMarket file and two tables without header; sizes that differ are an error."""
    x, n_genes, n_cells = read_matrix_market(spark, f"{folder}/{mtx}")
    var, obs = read_annotations(spark, f"{folder}/{genes}", gene_headers, sep).withColumnRenamed("pos", "gene"), read_annotations(spark, f"{folder}/{cells}", cell_headers, sep).withColumnRenamed("pos", "cell")
    if (var.count(), obs.count()) != (n_genes, n_cells):
        raise ValueError("annotations and matrix differ in size")
    return x, obs, var
