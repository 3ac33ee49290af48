"""Categories of products and pages by phrases, as array columns: no join, no shuffle."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelight.functions.binding import let
from framelight.functions.fixed_values import CATEGORY_TERMS, CHIMNEY_WORDS, CORDLESS_WORDS, ROBOT_WORDS, STATION_WORDS
from framelight.functions.text import catalog_text


def plain_term(term: str) -> str:
    """A phrase as catalog_text leaves it (the phrases hold no other characters)."""
    return " ".join(term.replace("-", " ").split())


def named_terms() -> Column:
    """Each category's phrases as they are written and as catalog_text leaves them, in the table's order."""
    return F.array(*[F.array(*[F.struct(F.lit(t).alias("term"), F.lit(plain_term(t)).alias("plain")) for t in terms]) for terms in CATEGORY_TERMS.values()])


def evidence(found: Column, place: Column) -> Column:
    """The phrases of one category that a catalog_text holds."""
    return F.transform(F.filter(F.get(named_terms(), place), lambda t: found.contains(t["plain"])), lambda t: t["term"])


def ranked_codes(codes: Column) -> Column:
    """The codes of the categories that were found, best first."""
    return F.sort_array(F.filter(codes, lambda c: c > 0), False)


def category_scores(text: Column) -> Column:
    """array<struct<order, place, score, category, evidence>>, best first; ties in the table's order. A phrase found adds its words, 2 at
    least; spellings that read alike add once each. An oven is none beside a microwave. Evidence is looked for in the categories that were found only."""

    def every(found: Column) -> Column:
        of = lambda c: F.struct((-code_score(c)).alias("order"), code_place(c).alias("place"), code_score(c).alias("score"), code_category(c).alias("category"), evidence(found, code_place(c)).alias("evidence"))
        return F.transform(ranked_codes(score_codes(found)), of)

    return let(catalog_text(text), every)


PLACES = 32  # more than there are categories


def score_codes(found: Column) -> Column:
    """array<int>, one for each category in the table's order: PLACES times its score in a catalog_text, and more the further ahead it stands; 0 for none.
    A greater code is a better category, and no two are equal but 0."""

    def one(place: int, category: str, terms: list[str]) -> Column:
        points = [F.when(found.contains(plain_term(t)), F.lit(max(2, len(plain_term(t).split())))).otherwise(F.lit(0)) for t in terms]
        score = sum(points[1:], points[0]) * PLACES
        out = score == 0
        if category == "Oven":
            out = found.contains(plain_term(CATEGORY_TERMS["Microwave"][0])) | found.contains(plain_term(CATEGORY_TERMS["Microwave"][1])) | out
        return F.when(out, F.lit(0)).otherwise(score + (PLACES - 1 - place))

    return F.array(*[one(i, c, t) for i, (c, t) in enumerate(CATEGORY_TERMS.items())])


def code_score(code: Column) -> Column:
    return F.floor(code / PLACES).cast("int")


def code_place(code: Column) -> Column:
    return (F.lit(PLACES - 1) - code % PLACES).cast("int")


def code_category(code: Column) -> Column:
    return F.get(F.array(*map(F.lit, CATEGORY_TERMS)), code_place(code))


def clear_winner(codes: Column, margin: int) -> Column:
    """The best category if it leads the second by the margin (a lone category always does)."""
    first = F.array_max(codes)
    second = code_score(F.coalesce(F.array_max(F.array_remove(codes, first)), F.lit(0)))
    return F.when((first > 0) & ((second == 0) | (code_score(first) >= second + margin)), code_category(first))


def category_of_text(text: Column, margin: int) -> Column:
    return let(let(catalog_text(text), score_codes), lambda codes: clear_winner(codes, margin))


def item_text(name: Column, product_url: Column) -> Column:
    return F.concat_ws(" | ", F.nullif(name, F.lit("")), F.nullif(product_url, F.lit("")))


def item_category(name: Column, product_url: Column) -> Column:
    return category_of_text(item_text(name, product_url), 1)


def with_codes(rows: DataFrame, text: Column) -> DataFrame:
    """rows with text_, a text cleaned, and codes_, its score_codes. The codes are made as a lambda's: as one generated method they are too long to be compiled."""
    return rows.withColumn("text_", catalog_text(text)).withColumn("codes_", let(F.col("text_"), score_codes))


def with_item_category(rows: DataFrame, name: str = "name", product_url: str = "product_url") -> DataFrame:
    """rows with item_category, for tables of many rows: item_category() in steps."""
    return with_codes(rows, item_text(F.col(name), F.col(product_url))).withColumn("item_category", clear_winner(F.col("codes_"), 1)).drop("text_", "codes_")


def page_category(context: Column) -> Column:
    return category_of_text(context, 2)


def confidence(score: Column, scores: Column) -> Column:
    """Of a detected category: high from 5 points and 2 ahead of the next lower or higher score, medium from 3."""
    rest = F.filter(F.transform(scores, lambda s: s["score"]), lambda s: s != score)
    second = F.coalesce(F.array_max(rest), F.lit(0))
    return F.when((score >= 5) & (score - second >= 2), "high").when(score >= 3, "medium").otherwise("low")


def archetype(name: Column, product_url: Column, category: Column) -> Column:
    """Finer groups in which products are compared."""
    text = F.lower(F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(product_url, F.lit(""))))
    has = lambda words: reduce(or_, (text.contains(w) for w in words))
    vacuum = F.when(has(ROBOT_WORDS) & has(STATION_WORDS), "robot_vacuum_station").when(has(ROBOT_WORDS), "robot_vacuum").when(has(CORDLESS_WORDS), "cordless_floorcare").otherwise("default")
    hood = F.when(has(CHIMNEY_WORDS), "chimney_hood").otherwise("hood")
    return F.when(category == "Vacuum cleaner", vacuum).when(category == "Hood", hood).otherwise("default")


def gate_mode(requested: Column, effective: Column) -> Column:
    return F.when(F.coalesce(requested, F.lit("")) != "", "manual").when(F.coalesce(effective, F.lit("")) != "", "auto_listing_context").otherwise("disabled_mixed_or_unknown")
