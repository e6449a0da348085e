"""Row types and the label space."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = "struct<start:int,len:int,label:int>"
CHUNKED_TEXT = f"id bigint, text string, chunks array<{CHUNK}>"
CORPUS = f"labelDefs map<string,string>, labelGrps array<int>, texts array<struct<id:bigint,text:string,chunks:array<{CHUNK}>>>"
WINDOWS = "enc_id bigint, text_id bigint, start_word int, n int, token_ids array<int>, embeds array<array<float>>"
SAMPLES = "sample_idx bigint, text_id bigint, enc_id bigint, target int, labels array<int>"
EVALUATION = "model_version int, sample_idx bigint, expected_labels array<float>, found_labels array<float>, confidence array<float>"


@dataclass(frozen=True)
class LabelSpace:
    """Heads in order, each with its sorted levels; label ids run through all heads from 0."""

    heads: tuple[str, ...]
    levels: tuple[tuple[int, ...], ...]

    @property
    def sizes(self) -> list[int]:
        return [len(found) for found in self.levels]

    @property
    def offsets(self) -> list[int]:
        return [sum(self.sizes[:i]) for i in range(len(self.heads))]

    @property
    def size(self) -> int:
        return sum(self.sizes)

    @property
    def names(self) -> dict[int, str]:
        """Label id to ``head_level``, by the original level."""
        pairs = [(h, v) for h, found in zip(self.heads, self.levels) for v in found]
        return {i: f"{h}_{v}" for i, (h, v) in enumerate(pairs)}

    @property
    def neutral(self) -> list[int]:
        """The first label of each head."""
        return self.offsets

    def label(self, head: str, level: Column) -> Column:
        """The id of a level of a head, by the level's dense index; null for an unknown level."""
        i = self.heads.index(head)
        return F.nullif(F.array_position(F.array(*map(F.lit, self.levels[i])), level), F.lit(0)).cast("int") - 1 + self.offsets[i]


def label_space(levels: DataFrame, heads: list[str]) -> LabelSpace:
    """Distinct levels of each head column. Level sets are small: they are what labels are numbered by."""
    row = levels.agg(*[F.array_sort(F.collect_set(h)).alias(h) for h in heads]).first()
    return LabelSpace(tuple(heads), tuple(tuple(row[h]) for h in heads))


def label_defs(levels: DataFrame, heads: list[str]) -> DataFrame:
    """head, level, dense_index, label, name as a table."""
    space = label_space(levels, heads)
    rows = [
        (h, v, i, space.offsets[k] + i, f"{h}_{v}")
        for k, (h, found) in enumerate(zip(space.heads, space.levels))
        for i, v in enumerate(found)
    ]
    return levels.sparkSession.createDataFrame(rows, "head string, level int, dense_index int, label int, name string")


def label_groups(levels: DataFrame, heads: list[str]) -> DataFrame:
    """head, head_no, first_label and n_labels."""
    space = label_space(levels, heads)
    rows = [(h, k, space.offsets[k], space.sizes[k]) for k, h in enumerate(space.heads)]
    return levels.sparkSession.createDataFrame(rows, "head string, head_no int, first_label int, n_labels int")
