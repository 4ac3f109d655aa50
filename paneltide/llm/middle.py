"""Fill-in-the-middle: cut texts into prefix, middle and suffix, and put the middle last.

A text is a sequence of units, its lines. Two hashes of the id choose two boundaries between
units. An indexable skip list over the units turns a boundary's rank into a code-point offset:
every link of every lane carries how many units and how many code points it spans, and a
search descends from the top lane, adding up the widths of the links it takes. So a search
takes about log(n) links, whatever the units' lengths. The form is built and taken apart again
by column expressions; only the two offsets come from the workers.

Cases: null texts are empty; empty texts, and texts that hold one of the signs, stay plain;
a null id is hashed as the empty string; equal cuts give an empty middle; repeated rows give
equal results; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from paneltide.llm.common import wrap

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
FIM_PERCENT = 100
SPM_PERCENT = 50


class SkipList:
    """Units in order, with express lanes; a node of a lane is in the next lane with a chance of one in four.

    Lane 0 has a link for every unit. Of a link, ``units`` and ``chars`` are its widths, and
    ``down`` is the link of the lane below that starts at the same boundary.
    """

    def __init__(self, sizes: np.ndarray):
        n = len(sizes)
        mixed = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        self.n = n
        self.lanes = [(np.ones(n, np.int64), sizes.astype(np.int64), None)]
        while len(mixed) > 1:
            up = mixed & np.uint64(3) == 0
            up[0] = True  # every lane starts at the first unit
            if up.all():
                break
            down = np.flatnonzero(up)
            units, chars, _ = self.lanes[-1]
            self.lanes.append((np.add.reduceat(units, down), np.add.reduceat(chars, down), down))
            mixed = mixed[down] >> np.uint64(2)

    def offset(self, rank: int) -> int:
        """Code points before unit ``rank``; the rank n is the end."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        at, chars = 0, 0
        for units, widths, down in reversed(self.lanes):
            while rank and units[at] <= rank:
                rank -= int(units[at])
                chars += int(widths[at])
                at += 1
            if not rank:
                return chars
            at = at if down is None else int(down[at])
        return chars


def line_sizes(text: str) -> np.ndarray:
    """Code points of each line, its line feed included."""
    sizes = np.fromiter(map(len, text.split("\n")), np.int64) + 1
    sizes[-1] -= 1
    return sizes if sizes[-1] else sizes[:-1]


@F.arrow_udf(StructType([StructField(x, LongType()) for x in ("n", "first", "second")]))
def cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Units of each text, and the code-point offsets of the boundaries ``one`` and ``two`` modulo n + 1, ascending."""
    out = np.empty((3, len(text)), np.int64)
    for k, (t, a, b) in enumerate(zip(text, one.to_pylist(), two.to_pylist())):
        units = SkipList(line_sizes(t.as_py()))
        ranks = sorted((a % (units.n + 1), b % (units.n + 1)))
        out[:, k] = units.n, units.offset(ranks[0]), units.offset(ranks[1])
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "first", "second"])


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame,
    carry: list[str] | None = None,
    id_column: str = "doc_id",
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output) per input row.

    ``form`` is plain (the text as it is), psm or spm: prefix, suffix, middle in this order,
    or suffix, prefix, middle, each after its sign.
    """
    names = carry or docs.columns
    held = wrap(docs, names if id_column in names else [*names, id_column])
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"row.`{id_column}`").cast("string"), F.lit("")))
    drawn = held.withColumn("digest", F.sha2(key, 256))
    text, digest = F.col("text"), F.col("digest")
    signed = F.lit(False)
    for sign in (PREFIX, SUFFIX, MIDDLE):
        signed |= F.contains(text, F.lit(sign))
    plain = (text == "") | signed | (_draw(digest, 2) % 100 >= fim_percent)
    form = F.when(plain, "plain").when(_draw(digest, 3) % 100 < spm_percent, "spm").otherwise("psm")
    cut_up = drawn.select("row", "text", form.alias("form"), cuts("text", _draw(digest, 0), _draw(digest, 1)).alias("cut"))
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix = F.concat(F.lit(PREFIX), F.substring(text, F.lit(1), first))
    middle = F.concat(F.lit(MIDDLE), F.substring(text, first + 1, second - first))
    suffix = F.concat(F.lit(SUFFIX), F.substring(text, second + 1, F.length(text)))
    formed = F.col("form") != "plain"
    return cut_up.select(
        F.struct(*[F.col(f"row.`{c}`").alias(c) for c in names]).alias("row"),
        F.col("cut.n").alias("n"),
        "form",
        F.when(formed, F.col("cut.first")).alias("prefix_chars"),
        F.when(formed, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"),
        F.when(F.col("form") == "psm", F.concat(prefix, suffix, middle))
        .when(F.col("form") == "spm", F.concat(suffix, prefix, middle))
        .otherwise(text)
        .alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form. The text holds no sign, so each sign stands once."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    prefix, suffix = (F.when(form == "psm", F.get(parts, F.lit(i))).otherwise(F.get(parts, F.lit(j))) for i, j in ((1, 2), (2, 1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))
