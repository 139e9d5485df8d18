"""The engine: pipeline text or chained calls over Spark DataFrames."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.exprs import Env, Value
from weir.lang.lexer import QueryError
from weir.lang.parser import parse
from weir.operators import rel as R
from weir.operators.lower import Plan, combined, run_scope
from weir.operators.pruning import bounds
from weir.operators.rel import Rel
from weir.plans import types as L


class Engine:
    """Runs pipeline queries. Names in ``from`` are tables given here, pools of a lake, catalog tables or files."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, lake=None, strict: bool = False):
        self.spark, self.lake, self.strict = spark, lake, strict
        self.tables: dict[str, DataFrame] = dict(tables or {})
        self.functions: dict[str, Callable] = {}

    @classmethod
    def over(cls, spark: SparkSession, directory: str, **options) -> Engine:
        """An engine whose tables are the Parquet files of a directory, read when they are named."""
        e = cls(spark, **options)
        e.directory = directory
        return e

    directory: str | None = None

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def function(self, name: str, f: Callable, returns: str) -> None:
        """A function in Python, run on Arrow batches: f gets and gives pandas Series."""
        self.functions[name] = F.pandas_udf(f, returns)

    def table(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if self.directory is not None and os.path.exists(f"{self.directory}/{name}.parquet"):
            self.tables[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
            return self.tables[name]
        if self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        raise QueryError(f"no such table or pool: {name}")

    def _source(self, kind: str, a: dict) -> Rel:
        if kind == "load":
            if self.lake is None:
                raise QueryError("load needs a lake")
            return self.lake.load(a["pool"], a["df"], branch=a["branch"], author=a["author"], message=a["message"], meta=a["meta"], as_frame=True)
        if kind == "pool":
            return self._pool(a)
        from weir.sources import read

        if kind == "file":
            r = read(self.spark, a["path"], a["format"])
        else:
            from weir.sources.http import fetch

            r = read(self.spark, fetch(self.spark, a["url"], a["method"], a["headers"], a["body"]), a["format"])
        return self._declared(R.of(r), a.get("order"))

    def _declared(self, r: Rel, order) -> Rel:
        """A source with a declared order is taken to be in it."""
        if order is None:
            return r
        from weir.operators.lower import sort

        return sort(r, {"by": [order], "reverse": False, "nulls": None}, self._plan())

    def _pool(self, a: dict) -> Rel:
        if self.lake is not None and (a["meta"] or a["at"] or a["name"] is None or self.lake.has(a["name"])):
            if a["name"] is None and a["regexp"] is None:
                return R.of(self.lake.meta(None, None, a["meta"]))
            if not a["glob"] and a["regexp"] is None:
                if a["meta"]:
                    return R.of(self.lake.meta(a["name"], a["at"], a["meta"]))
                low, high = bounds(a.get("where") or [], self.lake.info(a["name"])["key"])
                at = a["at"] or "main"
                return R.of(self.lake.read(a["name"], at) if low is None and high is None else self.lake.narrowed(a["name"], at, low, high))
        if a["meta"]:
            raise QueryError("meta queries need a lake")
        if a["glob"] or a["regexp"] is not None:
            known = sorted({*self.tables, *(self.lake.pools() if self.lake else []), *self._files()})
            names = [n for n in known if (re.search(a["regexp"], n) if a["regexp"] is not None else fnmatch.fnmatchcase(n, a["name"]))]
            if not names:
                raise QueryError("no table or pool matches")
            return combined([self._pool({**a, "name": n, "glob": False, "regexp": None}) for n in names])
        return self._declared(R.of(self.table(a["name"])), a.get("order"))

    def _files(self) -> list[str]:
        return [f[:-8] for f in os.listdir(self.directory) if f.endswith(".parquet")] if self.directory else []

    def _plan(self, streaming: bool = False) -> Plan:
        env = Env({}, lambda: Value(F.lit(None).cast("string"), L.NULL), python={n: _python(f) for n, f in self.functions.items()})
        return Plan(self._source, env, strict=self.strict, streaming=streaming)

    def _run(self, text: str, df: DataFrame | Rel | None) -> tuple[Rel, Plan]:
        streaming = isinstance(df, DataFrame) and df.isStreaming
        plan = self._plan(streaming)
        rels = None if df is None else [df if isinstance(df, Rel) else R.of(df)]
        return combined(run_scope(parse(text), rels, plan)), plan

    def query(self, text: str, df: DataFrame | None = None, ordered: bool = True) -> DataFrame:
        """The result of a pipeline, over df if its text begins with no source."""
        out, plan = self._run(text, df)
        return out.result(ordered and not plan.streaming)

    def values(self, text: str, source: DataFrame | str | None = None, format: str = "zson") -> DataFrame:
        """A pipeline over values of any type: a path, or a DataFrame of texts (column v or value). Gives texts in column v."""
        from weir.dynamic import run
        from weir.dynamic.evaluate import Scope
        from weir.sources.readers import sequence
        from weir.sources.writers import zson_lines

        def opened(kind: str, a: dict) -> DataFrame:
            if kind == "file":
                return sequence(self.spark, a["path"])
            return run.of_lines(zson_lines(self._source(kind, a).result()))

        if isinstance(source, str):
            source = sequence(self.spark, source)
        elif source is not None and set(source.columns) != {"v", "k"}:
            source = run.of_lines(source, "v" if "v" in source.columns else "value")
        return run.run_spark(parse(text), source, Scope(), opened).orderBy("k").select("v")

    def outputs(self, text: str, df: DataFrame | None = None) -> dict[str, DataFrame]:
        """All results: "main", named outputs and "debug"."""
        out, plan = self._run(text, df)
        return {"main": out.result(), **{n: r.result() for n, r in plan.outputs.items()}}

    def type_of(self, text: str, df: DataFrame | None = None) -> str:
        """The type of a pipeline's values, as text."""
        return L.text(self._run(text, df)[0].type)

    def explain(self, text: str, df: DataFrame | None = None) -> None:
        self.query(text, df).explain("formatted")

    def pipe(self, source: str | DataFrame) -> Pipe:
        return Pipe(self, R.of(self.table(source) if isinstance(source, str) else source))


def _python(f: Callable):
    def call(env, *vs):
        c = f(*[v.col for v in vs])
        t = f.returnType
        return Value(c, L.logical(t))

    return call


class Pipe:
    """A pipeline built by calls; each takes the text that follows the operator's name."""

    def __init__(self, engine: Engine, rel: Rel):
        self.engine, self.rel = engine, rel

    def then(self, text: str) -> Pipe:
        return Pipe(self.engine, self.engine._run(text, self.rel)[0])

    def __getattr__(self, name: str) -> Callable[..., Pipe]:
        op = name.rstrip("_")
        if op.startswith("_"):
            raise AttributeError(name)
        return lambda *args: self.then(" ".join([op, ", ".join(map(str, args))]).strip())

    def df(self, ordered: bool = True) -> DataFrame:
        return self.rel.result(ordered)

    @property
    def type(self) -> str:
        return L.text(self.rel.type)
