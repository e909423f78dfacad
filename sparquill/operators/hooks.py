"""Scorers as a table function of SQL: SELECT * FROM score(TABLE(t), 'fas'). What columns come back depends on the scorer."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@dataclass(frozen=True)
class Scorer:
    """Columns that a scorer needs, numbers that it gives, and its function: a row's needed values and the limit to those numbers."""

    needs: tuple[str, ...]
    gives: tuple[str, ...]
    of: Callable[..., tuple]


def similar(similarity: float, form: float, limit: float) -> tuple:
    return 0.8 * similarity + 0.2 * form, similarity, form


def retrieved(retrieval: float, overlap: float, form: float, limit: float) -> tuple:
    apart = 1.0 if overlap <= limit else max(0.0, 1 - 5 * (overlap - limit))
    return 0.6 * retrieval + 0.2 * form + 0.2 * apart, retrieval, form, apart


def predicted(logprobs: list[float], form: float, limit: float) -> tuple:
    share = min(1.0, math.exp(min(0.0, sum(logprobs) / len(logprobs) / 3))) if logprobs else 0.0
    return 0.8 * share + 0.2 * form, share, form


#: The scorers by their modes (fixed values); "" is for all other modes.
SCORERS = {
    "prs": Scorer(("similarity", "form"), ("score", "prs", "format"), similar),
    "fas": Scorer(("retrieval", "overlap", "form"), ("score", "fas", "format", "antileak"), retrieved),
    "ppl": Scorer(("logprobs", "form"), ("score", "ppl", "format"), predicted),
    "": Scorer(("form",), ("score", "format"), lambda form, limit: (form, form)),
}


@dataclass
class Plan(AnalyzeResult):
    """What every row needs: the places of the columns that stay, those of the scorer, and its mode."""

    kept: list[int] = field(default_factory=list)
    needed: list[int] = field(default_factory=list)
    mode: str = ""


def table_function(scorers: dict[str, Scorer]) -> type:
    """The handler of a table function over these scorers; one named "" takes modes that are not known."""

    class Score:
        def __init__(self, plan: Plan) -> None:
            self.plan, self.of = plan, scorers[plan.mode].of

        @staticmethod
        def analyze(rows: AnalyzeArgument, mode: AnalyzeArgument, limit: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument is a table: TABLE(t)")
            if not mode.isConstantExpression:
                raise ValueError("the mode is a constant")
            name = mode.value if mode.value in scorers else ""
            if name not in scorers:
                raise ValueError(f"no scorer {mode.value!r}; there are {', '.join(sorted(scorers))}")
            own, names = scorers[name], rows.dataType.names
            missing = [c for c in own.needs if c not in names]
            if missing:
                raise ValueError(f"scorer {name!r} needs the columns {', '.join(missing)}")
            kept = [i for i, c in enumerate(names) if c not in own.gives]
            schema = T.StructType([rows.dataType.fields[i] for i in kept] + [T.StructField(c, T.DoubleType()) for c in own.gives])
            return Plan(schema=schema, kept=kept, needed=[names.index(c) for c in own.needs], mode=name)

        def eval(self, row: Row, mode: str, limit: float = 0.8) -> Iterator[tuple]:
            asked = [row[i] for i in self.plan.needed]
            empty = len(self.plan.schema.names) - len(self.plan.kept)
            found = (None,) * empty if any(v is None for v in asked) else self.of(*asked, float(limit))
            yield (*(row[i] for i in self.plan.kept), *found)

    return Score


def register(spark: SparkSession, name: str = "score", scorers: dict[str, Scorer] | None = None) -> None:
    """Makes the table function name(TABLE(t), mode[, limit]) known to SQL.

    It gives the table's columns, then the scorer's numbers, which take the place of columns of the same names. A row that lacks a
    needed value has nulls. Rows stay where they are: no shuffle. Spark calls it for each row, so it is for scorers in Python; where the
    built-in formulas do, reward_function() is far faster. Rows travel pickled, as with Arrow Spark makes a batch of every single one
    (100,000 rows: 14 s against 2 s).
    """
    spark.udtf.register(name, udtf(table_function(SCORERS if scorers is None else scorers), useArrow=False))


def reward_function(spark: SparkSession, name: str = "reward") -> None:
    """Makes name(mode, form, similarity, retrieval, overlap, predicted) known to SQL: the built-in formulas as an expression, without Python."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(mode STRING, form DOUBLE, similarity DOUBLE, retrieval DOUBLE, overlap DOUBLE, predicted DOUBLE) RETURNS DOUBLE
    RETURN CASE mode WHEN 'prs' THEN 0.8D * similarity + 0.2D * form
        WHEN 'fas' THEN 0.6D * retrieval + 0.2D * form + 0.2D * CASE WHEN overlap <= 0.8D THEN 1D ELSE greatest(0D, 1D - 5D * (overlap - 0.8D)) END
        WHEN 'ppl' THEN 0.8D * predicted + 0.2D * form ELSE form END""")
