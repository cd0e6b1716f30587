"""Usage of style values over all files, colour clusters, and tokens drawn from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import color, values
from inkstone.operators.rules import facts_of
from inkstone.session import scratch_folder
from inkstone.sources.config import Tokens

# Families that are keywords.
KEYWORDS = "inherit initial unset revert normal sans-serif serif monospace cursive fantasy system-ui ui-sans-serif ui-serif ui-monospace ui-rounded".split()
NEAR, LEAST_COUNT = 10.0, 2
#: Colours that a round of clusters folds one by one, and representatives that are compared with a batch of colours at a time.
ROUND, HEADS_AT_ONCE, LAB = 4096, 32, ("c_l", "c_a", "c_b")


def values_in(decls: DataFrame, *carried: str, skip_tokens: bool = False) -> DataFrame:
    """category, value and the carried columns for every colour, px spacing, px font size, family and px radius in declarations, in one pass."""
    name, value, none = F.col("name"), F.col("value"), F.array().cast("array<struct<category:string,raw:string>>")
    numbers = F.split(F.trim(F.regexp_replace(value, "/", " ")), r"\s+")

    def listed(category: str, chosen: Column, raws: Column) -> Column:
        return F.when(chosen, F.transform(raws, lambda r: F.struct(F.lit(category).alias("category"), r.alias("raw")))).otherwise(none)

    hits = F.concat(
        listed("color", values.has_color(value), values.colors_in(value)),
        listed("spacing", name.rlike(values.SPACING_PROP), numbers),
        listed("fontSize", name == "font-size", numbers),
        listed("fontFamily", (name == "font-family") & ~values.is_token(value), F.array(values.first_family(value))),
        listed("radius", name == "border-radius", numbers),
    )
    each = decls.select(*carried, F.inline(F.when(~values.is_token(value), hits) if skip_tokens else hits))
    px = F.when(F.col("category").isin("spacing", "fontSize", "radius"), values.px_of(F.col("raw"), rem=False))
    each, category = values.once(each, px=px), F.col("category")
    found = F.when(category == "color", color.normalise(F.col("raw"))).when(category == "fontFamily", F.when(~F.lower("raw").isin(*KEYWORDS, ""), F.col("raw"))).otherwise(values.number_text(F.col("px")))
    return values.once(each, value=found).where("value is not null").select("category", "value", *carried)


def declarations(facts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return facts_of(facts, "decl").where(F.col("kind").isin(*kinds))


KINDS = ("css", "scss", "less", "jsx")


def occurrences(facts: DataFrame, kinds: tuple[str, ...] = KINDS, skip_tokens: bool = False) -> DataFrame:
    """category, value, file, line, col of every value in declarations.

    skip_tokens leaves out declarations that refer to a token anywhere, as drift does."""
    return values_in(declarations(facts, kinds), "file", "line", "col", skip_tokens=skip_tokens)


def counted(facts: DataFrame, kinds: tuple[str, ...] = KINDS, skip_tokens: bool = False) -> DataFrame:
    """category, value, n of the values in each different declaration, which is taken apart once however often it stands in code."""
    different = declarations(facts, kinds).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    return values_in(different, "n", skip_tokens=skip_tokens)


def usage(facts: DataFrame) -> DataFrame:
    """category, value, n; families also count where :root variables quote them."""
    quoted = facts_of(facts, "decl").where((F.trim("selector") == ":root") & F.col("name").startswith("--")).select(F.explode(F.regexp_extract_all("value", F.lit("['\"]([A-Za-z][^'\"]{1,50})['\"]"), F.lit(1))).alias("value"))
    return counted(facts).unionByName(quoted.select(F.lit("fontFamily").alias("category"), "value", F.lit(1).cast("long").alias("n"))).groupBy("category", "value").agg(F.sum("n").alias("n"))


def at_least(used: DataFrame, n: int = LEAST_COUNT) -> DataFrame:
    return used.where(F.col("n") >= n)


def css_variables(facts: DataFrame) -> DataFrame:
    """hex, name: the first custom property that defines each colour."""
    defined = facts_of(facts, "decl").where(F.col("name").startswith("--")).withColumn("hex", color.normalise(F.col("value"))).where("hex is not null")
    return defined.groupBy("hex").agg(F.min_by("name", F.struct("file", "seq")).alias("name"))


def _homes(heads: np.ndarray, first: int, near: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that gives each colour the first of the heads, numbered from first, that is within near; none if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = np.stack([np.asarray(batch.column(c)) for c in LAB], axis=1)
            home, open_ = np.full(len(mine), -1), np.arange(len(mine))
            for at in range(0, len(heads), HEADS_AT_ONCE):
                row, head = color.near_pairs(mine[open_], heads[at : at + HEADS_AT_ONCE], near)
                own, place = np.unique(row, return_index=True)  # pairs stand in the order of heads
                home[open_[own]] = first + at + head[place]
                open_ = np.delete(open_, own)
            columns = {c: batch.column(c) for c in ("value", "n", *LAB)} | {"home": pa.array(home, pa.int32(), mask=home < 0)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def clusters(colors: DataFrame, near: float = NEAR) -> DataFrame:
    """rank, representative, members, total for colors(value, n).

    Greedy by count: a colour joins the first cluster whose representative is within `near`. So a colour is a representative if none before it is that
    near. The first ROUND colours that have no home are folded one after the other; then all others look for their home among the new representatives at
    once, and those without one go on to the next round. Representatives are `near` apart, so that the space of colours has room for some hundreds only,
    whatever the input; all that stays in one place are these and a round's colours."""
    spark = colors.sparkSession
    rest = color.with_lab(colors.select("value", "n"), "value", "c").repartition(spark.sparkContext.defaultParallelism)
    schema = f"value string, n long, {', '.join(f'{c} double' for c in LAB)}, home int"
    rest, done, count = _written(rest.withColumn("home", F.lit(None).cast("int")), schema), [], 0
    while first := rest.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(ROUND).collect():
        heads = color.apart(np.array([[r[c] for c in LAB] for r in first], float), near)
        placed = _written(rest.mapInArrow(_homes(heads, count, near), schema), schema)
        count += len(heads)
        done.append(placed.where("home is not null"))
        rest = placed.where("home is null")
    homes = reduce(DataFrame.unionByName, done) if done else rest
    members = homes.groupBy("home").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "value"))).alias("m"), F.sum("n").alias("total"))
    ranks = homes.groupBy("home").agg(F.sum("n").alias("t")).select("home", F.row_number().over(Window.orderBy(F.desc("t"), "home")).alias("rank"))  # one row for each cluster
    return members.join(F.broadcast(ranks), "home").select("rank", F.col("m")[0]["value"].alias("representative"), F.col("m")["value"].alias("members"), "total")


def _written(rows: DataFrame, schema: str) -> DataFrame:
    path = scratch_folder(rows.sparkSession, "colors")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def named_clusters(found: DataFrame, variables: DataFrame) -> DataFrame:
    """clusters with a token name: the first member's variable, else --color-<rank>."""
    each = found.select("rank", F.posexplode("members").alias("pos", "hex")).join(variables, "hex").groupBy("rank").agg(F.min_by("name", "pos").alias("variable"))
    return found.join(each, "rank", "left").withColumn("name", F.coalesce("variable", F.concat(F.lit("--color-"), F.col("rank").cast("string")))).drop("variable")


def draft_tokens(facts: DataFrame) -> Tokens:
    """Tokens of a code base: colour clusters by name, and numbers and families used twice or more. Configuration-sized by nature."""
    used = usage(facts)
    named = named_clusters(clusters(used.where("category = 'color'").select("value", "n")), css_variables(facts))
    lists: dict[str, list] = {"spacing": [], "fontSize": [], "radius": [], "fontFamily": []}
    for r in at_least(used).where("category <> 'color'").collect():
        lists[r["category"]].append(r["value"] if r["category"] == "fontFamily" else float(r["value"]))
    colors = {r["name"]: r["representative"] for r in named.orderBy("rank").collect()}
    return Tokens(colors, sorted(lists["spacing"]), sorted(lists["fontSize"]), sorted(lists["radius"]), sorted(lists["fontFamily"]))
