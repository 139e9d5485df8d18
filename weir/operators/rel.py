"""The state of a pipeline between two operators."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions.exprs import Env, Value, record
from weir.plans import types as L
from weir.plans.types import Type

HIDDEN = "__"


@dataclass
class Rel:
    """A DataFrame whose columns are the fields of ``this``, or whose column "this" is.

    Hidden columns travel along: keys of the order, rows of an outer scope and its locals.
    """

    df: DataFrame
    #: the type of this; a record's fields are columns
    type: Type
    #: (hidden column, descending, nulls first), most significant first
    order: list[tuple[str, bool, bool]] = field(default_factory=list)
    #: hidden columns that separate the scopes of a lateral traversal
    scope: list[str] = field(default_factory=list)
    locals: dict[str, Value] = field(default_factory=dict)
    #: fields whose values order the rows, where all of an order is fields
    sorted_by: tuple[str, ...] = ()

    @property
    def is_record(self) -> bool:
        return L.under(self.type)[0] == "record"

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(HIDDEN)]

    def columns(self) -> dict[str, Value]:
        if not self.is_record:
            return {}
        ntz = {f.name for f in self.df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
        return {n: Value(F.col(_q(n)), t, ntz=n in ntz) for n, t in L.under(self.type)[1]}

    def this(self) -> Value:
        if self.is_record:
            return record(self.columns())
        ntz = isinstance(self.df.schema["this"].dataType, T.TimestampNTZType)
        return Value(F.col("this"), self.type, ntz=ntz)

    def env(self, base: Env) -> Env:
        return replace(base, fields=self.columns(), this=self.this, names={**base.names, **self.locals}, df=self.df)

    def order_by(self) -> list[Column]:
        return [_directed(F.col(c), desc, first) for c, desc, first in self.order]

    def project(self, fields: dict[str, Value]) -> Rel:
        """Other fields; hidden columns stay."""
        from weir.functions.exprs import error_col, error_type

        cols, types = [F.col(h) for h in self.hidden], []
        for n, v in fields.items():
            t = error_type(v) if v.missing else v.type
            c = error_col(v) if v.missing else v.col
            if L.is_prim(t, "null"):
                c = c.cast("string")
            meta = L.metadata(t)
            cols.append(c.alias(n, metadata=meta) if meta else c.alias(n))
            types.append((n, t))
        return replace(self, df=self.df.select(*cols), type=("record", types), sorted_by=tuple(x for x in self.sorted_by if x in fields))

    def yielding(self, v: Value) -> Rel:
        """Other values of this: a record's fields become columns."""
        if L.under(v.type)[0] == "record" and L.under(v.type)[1]:
            df = self.df.select(*self.hidden, v.col.alias("__this")).select(*self.hidden, *[F.col("__this").getField(n).alias(n, metadata=L.metadata(t)) if L.metadata(t) else F.col("__this").getField(n).alias(n) for n, t in L.under(v.type)[1]])
            return replace(self, df=df, type=v.type, sorted_by=())
        t = ("error", L.STRING) if v.missing else v.type
        from weir.functions.exprs import error_col

        c = error_col(v) if v.missing else v.col
        if L.is_prim(t, "null"):
            c = c.cast("string")
        meta = L.metadata(t)
        return replace(self, df=self.df.select(*self.hidden, c.alias("this", metadata=meta) if meta else c.alias("this")), type=t, sorted_by=())

    def filter(self, c: Column) -> Rel:
        return replace(self, df=self.df.where(c))

    def result(self, ordered: bool = True) -> DataFrame:
        """The DataFrame without hidden columns, in order."""
        df = self.df
        if ordered and self.order:
            df = df.orderBy(*self.order_by())
        keep = [c for c in df.columns if not c.startswith(HIDDEN)]
        return df.select(*[F.col(_q(c)) for c in keep]) if len(keep) != len(df.columns) else df


def _directed(c: Column, desc: bool, first: bool) -> Column:
    if desc:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def _q(n: str) -> str:
    return "`" + n.replace("`", "``") + "`"


def of(df: DataFrame) -> Rel:
    """A pipeline that begins with a DataFrame."""
    return Rel(df, ("record", [(f.name, L.logical(f.dataType, f.metadata)) for f in df.schema.fields]))
