"""A user's own window scorer over any number of rows, with its output checked (provider registry of §2.12, X-07)."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Scorer = Callable[[pa.Table], pa.Table]

#: A column of texts that a scorer may return beside those it declared: the errors of rows that it can't score, null for others.
ERROR = "error"


class Registry:
    """Scorers by name; a name is taken once."""

    def __init__(self):
        self._scorers: dict[str, tuple[Scorer, str]] = {}

    def register(self, name: str, scorer: Scorer, schema: str) -> None:
        if name in self._scorers:
            raise ValueError(f"scorer {name} is registered already")
        self._scorers[name] = (scorer, schema)

    def score(self, df: DataFrame, name: str, inputs: list[str], **how) -> DataFrame:
        if name not in self._scorers:
            raise KeyError(f"no scorer {name}; there are {sorted(self._scorers)}")
        scorer, schema = self._scorers[name]
        return score_windows(df, scorer, schema, inputs, **how)


def checked(got, names: list[str], kinds: list[pa.DataType], n: int) -> tuple[list[pa.Array], pa.Array | None]:
    """The scorer's columns in the order and types that it declared, one value for each row, and its own errors of rows if it gives any; or an error."""
    if not isinstance(got, (pa.Table, pa.RecordBatch)):
        raise TypeError(f"a scorer returns an Arrow table, not {type(got).__name__}")
    if got.num_rows != n:
        raise ValueError(f"{got.num_rows} rows came back for {n}")
    given = got.schema.names
    if missing := [c for c in names if c not in given]:
        raise ValueError(f"columns {missing} are missing")

    def column(c: str, kind: pa.DataType) -> pa.Array:
        x = got.column(c)
        if isinstance(x, pa.ChunkedArray):
            x = x.chunk(0) if x.num_chunks == 1 else x.combine_chunks()
        return x if x.type == kind else x.cast(kind)

    out = [column(c, kind) for c, kind in zip(names, kinds, strict=True)]
    return out, column(ERROR, pa.string()) if ERROR in given and ERROR not in names else None


def score_windows(df: DataFrame, scorer: Scorer, schema: str, inputs: list[str], rows: int = 4096, status: str = "status") -> DataFrame:
    """Every row with the scorer's columns and a status, `ok` or the error; one row out for each in.

    The scorer gets Arrow tables of the input columns, `rows` at most, and returns one of the columns
    that `schema` declares. If it fails on a table, or returns something else, its halves are tried, and so on down to
    single rows, and only those that fail have nulls and the error's text. A scorer that knows the rows it fails on
    returns their errors as a column `error`, and no table is tried again. A scorer keeps no order between tables.
    """
    names = T._parse_datatype_string(schema).names
    fields = T._parse_datatype_string(schema).fields
    if clash := [c for c in [*names, status] if c.lower() in {x.lower() for x in df.columns}]:
        raise ValueError(f"columns {clash} are there already")
    out = T.StructType([*df.schema.fields, *fields, T.StructField(status, T.StringType())])
    width = len(df.columns)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]

        def scored(asked):
            n = asked.num_rows
            try:
                columns, errors = checked(scorer(asked), names, kinds, n)
            except Exception as e:  # a provider's failure is a row's status
                if n > 1:
                    return None
                return [*[pa.nulls(1, k) for k in kinds], pa.array([f"{type(e).__name__}: {e}"])]
            return [*columns, pa.nulls(n, pa.string()) if errors is None else errors]

        for b in batches:
            asked = pa.Table.from_batches([b]).select(inputs)
            done, waiting = [], [(at, min(at + rows, b.num_rows)) for at in range(0, b.num_rows, rows)][::-1]
            while waiting:
                lo, hi = waiting.pop()
                if got := scored(asked.slice(lo, hi - lo)):
                    done.append(got)
                else:
                    half = (lo + hi) // 2
                    waiting += [(half, hi), (lo, half)]
            if done:  # one batch out for each in, whatever failed
                *made, errors = [pa.concat_arrays(parts) for parts in zip(*done, strict=True)]
                if errors.null_count < b.num_rows:
                    fine = errors.is_null()
                    made = [pc.if_else(fine, x, pa.scalar(None, x.type)) for x in made]
                    errors = pc.utf8_slice_codeunits(errors, 0, 500)
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(width)], *made, pc.fill_null(errors, "ok")], names=out.names)

    return df.mapInArrow(run, out)


def composition(table: pa.Table) -> pa.Table:
    """A stock scorer: the share of charged residues in `peptide`, and the difference of positive and negative ones. A null peptide is an error."""
    peptides = table.column("peptide")
    plus, minus = (pc.count_substring_regex(peptides, letters) for letters in ("[KR]", "[DE]"))
    size = pc.utf8_length(peptides)
    shares = pc.divide(pc.add(plus, minus).cast(pa.float64()), pc.max_element_wise(size, 1))  # 0 of an empty one
    made = {"charged": shares, "charge": pc.subtract(plus, minus)}
    if peptides.null_count:
        made[ERROR] = pc.if_else(peptides.is_null(), "ValueError: peptide is null", pa.scalar(None, pa.string()))
    return pa.table(made)


STOCK = Registry()
STOCK.register("composition", composition, "charged double, charge int")
