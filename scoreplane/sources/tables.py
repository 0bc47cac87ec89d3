"""Parquet tables and materialised intermediates.

``materialize`` writes a derived table once into the shared checkpoint folder
(``spark.checkpoint.dir``) and reads it back: lineage is cut, the result
survives executor loss, and later plans see a plain scan (filters and
partition pruning reach the files).

A stored table is served only while nothing it was made from has changed: its
name holds a digest of every input file (path, length, modification time), of the
whole analysed plan with the place of every leaf in it, and of the caller's key.  A plan that these do not
tell apart from another (rows held in memory by an RDD, subqueries, the current time, Python code without a key) is never
served to anyone else: it is written under a name of its own.  A table is written under a name of its own first
and published by one rename, so two sessions never write the same files and a
reader never sees half a table."""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import sysconfig
import types
import uuid
from contextlib import contextmanager
from typing import Callable, Sequence

from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField

from scoreplane.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def input_fingerprint(spark: SparkSession, roots: Sequence[str]) -> str:
    """Path, length and modification time of every file under the roots, folded into one text.

    Spark lists the files (in parallel beyond a few) and folds the rows; no file is opened and no list passes the driver."""
    if not roots:
        return "none"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(sorted(set(roots))).selectExpr(
        "XXHASH64(path, length, modificationTime) AS a", "HASH(modificationTime, length, path) AS b")
    row = listed.selectExpr("COUNT(*) AS n", "BIT_XOR(a) AS a", "BIT_XOR(b) AS b").first()
    return f"{row.n}:{row.a}:{row.b}"


#: Parts of a plan whose text does not say what they return.
_UNTOLD = ("PLAN_EXPRESSION", "CURRENT_LIKE")
_CODE = ("PYTHON_UDF", "SCALA_UDF")


@contextmanager
def _whole_text(spark: SparkSession):
    """Plan texts with every column: Spark shortens them behind a number of fields."""
    name, before = "spark.sql.debug.maxToStringFields", None
    try:
        before = spark.conf.get(name, None)
        spark.conf.set(name, str(2**31 - 1))
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _leaves(plan) -> tuple[list[str], list[str]] | None:
    """(what every leaf holds, in the plan's order; the folders and files read), None where a leaf does not tell."""
    held, roots = [], []
    leaves = plan.collectLeaves()
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        kind = leaf.nodeName()
        if kind.startswith("LogicalRelation") or kind.startswith("Relation"):
            relation = leaf.relation()
            if not relation.getClass().getName().endswith("HadoopFsRelation"):
                return None
            paths = relation.location().rootPaths()
            own = [paths.apply(i).toString() for i in range(paths.size())]
            roots += own
            held.append(f"{relation.fileFormat().getClass().getName()} {relation.options().toString()} {own}")
        elif kind == "LocalRelation":
            held.append(leaf.data().mkString("|"))
        elif kind in ("Range", "OneRowRelation"):
            held.append(kind)  # the plan's text has the rest
        else:
            return None
    return held, roots


def _renumbered(text: str) -> str:
    """Expression ids differ from run to run: they are numbered by their first place in the text instead, so
    two columns of one name stay two."""
    ids: dict[str, str] = {}
    text = re.sub(r"lambda \w+?(?=#)", "lambda ", text)
    return re.sub(r"#(\d+)L?", lambda m: "#" + ids.setdefault(m[1], str(len(ids))), text)


def plan_fingerprint(df: DataFrame, code_is_told: bool = False) -> str | None:
    """Digest of the analysed plan, its leaves and their files; None where two different plans could share it."""
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed()
    pattern = spark._jvm.org.apache.spark.sql.catalyst.trees.TreePattern
    if any(plan.containsPattern(getattr(pattern, p)()) for p in (_UNTOLD if code_is_told else _UNTOLD + _CODE)):
        return None
    leaves = _leaves(plan)
    if leaves is None:
        return None
    with _whole_text(spark):
        text = _renumbered(plan.toString())
    told = "\n".join([text, *leaves[0], input_fingerprint(spark, leaves[1]), df.schema.json()])
    return hashlib.sha256(told.encode()).hexdigest()


class _Untold(Exception):
    pass


def _library(module) -> bool:
    place = getattr(module, "__file__", None)
    return place is None or place.startswith(tuple({sysconfig.get_path(k) for k in ("stdlib", "purelib", "platlib")}))


def code_fingerprint(fn: Callable) -> str | None:
    """Digest of a function: its code, defaults, what it closes over, and the functions and values it names, helpers
    of other modules included; installed libraries count by name and version.  None where some value has no text of its own."""
    seen: dict[int, int] = {}

    def names(code: types.CodeType) -> set[str]:
        return set(code.co_names).union(*(names(c) for c in code.co_consts if isinstance(c, types.CodeType)))

    def function(f: types.FunctionType):
        if id(f) in seen:
            return "seen", seen[id(f)]
        seen[id(f)] = len(seen)
        if _library(sys.modules.get(f.__module__)) and f.__module__ != "__main__":
            return "library", f.__module__, f.__qualname__
        used = names(f.__code__)
        held = {n: f.__globals__[n] for n in used if n in f.__globals__}
        reached = [getattr(m, n) for m in held.values() if isinstance(m, types.ModuleType) and not _library(m)
                   for n in sorted(used) if hasattr(m, n)]
        return (told(f.__code__), told(f.__defaults__), told(f.__kwdefaults__), told(held), told(reached),
                [told(c.cell_contents) for c in f.__closure__ or ()])

    def told(x):
        if x is None or x is ... or isinstance(x, (bool, int, float, complex, str, bytes)):
            return type(x).__name__, repr(x)
        if isinstance(x, (list, tuple)):
            return type(x).__name__, [told(v) for v in x]
        if isinstance(x, (set, frozenset)):
            return type(x).__name__, sorted(map(repr, map(told, x)))
        if isinstance(x, dict):
            return "dict", sorted(repr((told(k), told(v))) for k, v in x.items())
        if isinstance(x, types.CodeType):
            return x.co_code.hex(), x.co_names, x.co_varnames, x.co_freevars, [told(c) for c in x.co_consts]
        if isinstance(x, types.FunctionType):
            return function(x)
        if isinstance(x, types.MethodType):
            return function(x.__func__), told(x.__self__)
        if isinstance(x, functools.partial):
            return told(x.func), told(x.args), told(x.keywords)
        if isinstance(x, types.ModuleType):
            return "module", x.__name__, str(getattr(x, "__version__", ""))
        if isinstance(x, types.BuiltinFunctionType):
            return "builtin", x.__module__, x.__qualname__
        if isinstance(x, type):
            own = {} if _library(sys.modules.get(x.__module__)) else {
                k: v for k, v in vars(x).items() if isinstance(v, types.FunctionType)}
            return "type", x.__module__, x.__qualname__, told(own)
        if isinstance(x, Accumulator):
            return "accumulator"  # tasks only add to it
        if isinstance(x, (DataType, StructField)):
            return "schema", x.json()
        if isinstance(x, DataFrame) and (plan := plan_fingerprint(x)):
            return "plan", plan
        raise _Untold

    try:
        return hashlib.sha256(repr(told(fn)).encode()).hexdigest()
    except (_Untold, ValueError):  # an empty cell is a value error
        return None


def materialize(df: DataFrame, name: str, key: str | None = "", partition_by: Sequence[str] = (),
                max_records_per_file: int | None = None) -> DataFrame:
    """Write ``df`` once under the checkpoint folder and read it back with its own schema.

    ``key`` names what the plan does not show, such as the code of a model call; a plan that runs Python code is served again
    only with a key.  None says that there is no such name: the table is never served again."""
    spark = df.sparkSession
    plan = None if key is None else plan_fingerprint(df, code_is_told=bool(key))
    made_of = uuid.uuid4().hex if plan is None else "\n".join([plan, key, *partition_by])
    path = f"{_root(spark)}/{name}-{hashlib.sha256(made_of.encode()).hexdigest()[:24]}"
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        attempt = f"{path}.{uuid.uuid4().hex}"
        writer = df.write
        if max_records_per_file:
            writer = writer.option("maxRecordsPerFile", max_records_per_file)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(attempt)
        _, made = _fs(spark, attempt)
        # a rename into an existing folder would move the attempt inside it, so the loser of a race drops its own
        if fs.exists(target) or not fs.rename(made, target):
            fs.delete(made, True)
    if plan is None:
        fs.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def _root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scoreplane-tables"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared place, gone when the application ends."""
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    fs, target = _fs(spark, path)
    fs.deleteOnExit(target)
    return path


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under a name of its own in the checkpoint folder and read it back (cuts the lineage)."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(spark: SparkSession, made: str, target: str) -> None:
    """Put a finished folder in the place of an older one by renames; a reader finds the one or the other whole."""
    fs, new = _fs(spark, made)
    _, place = _fs(spark, target)
    fs.mkdirs(place.getParent())
    _, old = _fs(spark, f"{target.rstrip('/')}.{uuid.uuid4().hex}")
    had = fs.exists(place) and fs.rename(place, old)
    if not fs.rename(new, place):
        raise OSError(f"could not move {made} to {target}")
    if had:
        fs.delete(old, True)


def has_files(spark: SparkSession, directory: str) -> bool:
    """Whether a directory exists and is not empty."""
    fs, target = _fs(spark, directory)
    return bool(fs.exists(target)) and len(fs.listStatus(target)) > 0


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file to its final place, in place of an older one of that name."""
    fs, old = _fs(spark, source)
    _, new = _fs(spark, target)
    fs.mkdirs(new.getParent())
    fs.delete(new, False)
    if not fs.rename(old, new):
        raise OSError(f"could not move {source} to {target}")


def files_in(spark: SparkSession, directory: str) -> list[tuple[str, str]]:
    """(parent folder's name, path) of the data files one level below ``directory``."""
    fs, target = _fs(spark, directory)
    out = []
    for folder in fs.listStatus(target):
        if folder.isDirectory():
            out += [(folder.getPath().getName(), f.getPath().toString()) for f in fs.listStatus(folder.getPath())
                    if f.getPath().getName().startswith("part-")]
    return out


def touch(spark: SparkSession, path: str, text: str = "") -> None:
    """A small file with the given text."""
    fs, target = _fs(spark, path)
    out = fs.create(target)
    out.write(bytearray(text.encode()))
    out.close()


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """The folders that a path pattern fits."""
    fs, target = _fs(spark, pattern)
    return [f.getPath().toString() for f in fs.globStatus(target) or () if f.isDirectory()]


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def published(spark: SparkSession, directory: str) -> list[str]:
    """Folders one level below ``directory`` whose write has succeeded, in order of their names."""
    fs, target = _fs(spark, directory)
    if not fs.exists(target):
        return []
    found = [f.getPath().toString() for f in fs.listStatus(target) if f.isDirectory()]
    return sorted(f for f in found if fs.exists(_fs(spark, f"{f}/_SUCCESS")[1]))
