"""Order of name parts (1: surname first, -1: given name first, 0: unknown) and author lists with a majority vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens.functions import dims
from namelens.functions import text as t

LABELS = {1: "SURNAME_FIRST", 0: "UNDETERMINED", -1: "GIVEN_NAME_FIRST"}
#: Patterns of initials and patronymics, in Unicode and without case.
INITIALS = r"(?iU)^\b(\w|([jy][aeiou]|s?ch|мл|jr|ts|[kpstz]h))\b"
PATRONYM = r"(?iU)\w+(ич|вна|инична|ovich|evich|ovna|evna)\b"


def is_given(part: Column) -> Column:
    """Whether a part, in upper case, looks like a given name, initials or a patronymic."""
    frequent = [k for k, v in dims.GIVEN_FREQUENCY.items() if v >= 30]
    return t.is_in(part, frequent) | part.rlike(INITIALS) | part.rlike(PATRONYM) | (F.length(F.regexp_replace(part, r"(?U)\W", "")) == 1)


def name_parts(c: Column) -> Column:
    return F.filter(F.split(t.clean_name(F.coalesce(c, F.lit(""))), r"(?U)[\s\-]+"), lambda x: x != "")


def with_order(df: DataFrame, name: str, *, dictionary: dims.Dictionary | None = dims.DEFAULT) -> DataFrame:
    """df with name_order. Without a dictionary no part counts as a surname."""
    known = (lambda c: t.is_known_surname(c, dictionary)) if dictionary else (lambda c: F.lit(False))
    x = df.withColumn("__o", F.filter(F.split(F.coalesce(F.col(name), F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    x = x.withColumn("__p", F.transform(name_parts(F.col(name)), F.upper))
    first, last = (lambda k: F.get(k, F.lit(0))), (lambda k: F.get(k, F.size(k) - 1))
    joined = lambda c: F.replace(F.upper(c), F.lit("-"), F.lit(""))
    x = x.withColumns(
        {
            "__g": F.transform("__p", is_given), "__sa": known(first("__p")), "__sb": known(last("__p")),
            "__ha": F.coalesce(first("__o").contains("-"), F.lit(False)), "__hb": F.coalesce(last("__o").contains("-"), F.lit(False)),
            "__oa": known(joined(first("__o"))), "__ob": known(joined(last("__o"))),
        }
    )
    c = F.col
    n, g = F.size("__p"), lambda i: F.coalesce(F.get("__g", F.lit(i)), F.lit(False))
    two = F.size("__o") >= 2
    second = F.get("__p", F.lit(1))
    some = lambda a: F.exists(a, lambda v: v)
    order = (
        F.when(two & c("__ha") & ~c("__hb") & c("__ob"), -1)
        .when(two & ~c("__ha") & c("__hb") & c("__oa"), 1)
        .when(n < 2, 0)
        .when((n == 2) & (F.length(second) <= 3) & second.endswith(".") & second.rlike(r"(?U)^\p{L}") & c("__sa"), 1)
        .when(c("__sa") & ~c("__sb"), 1)
        .when(c("__sb") & ~c("__sa"), -1)
        .when(c("__sa"), F.when((n > 2) & some(F.slice("__g", F.lit(2), F.greatest(n - 2, F.lit(0)))), 1).when(g(1), 1).otherwise(0))
        .when(~some(c("__g")), 0)
        .when(g(0), -1)
        .otherwise(1)
    )
    return x.withColumn("name_order", order).select(*df.columns, "name_order")


def details(df: DataFrame, name: str, *, dictionary: dims.Dictionary | None = dims.DEFAULT) -> DataFrame:
    """df with name_order, its label, the parts, which of them look given, is_non_chinese and confidence."""
    x = with_order(df, name, dictionary=dictionary).withColumn("name_parts", name_parts(F.col(name)))
    x = x.withColumn("is_first_name_map", F.transform("name_parts", lambda p: is_given(F.upper(p))))
    known = (lambda c: t.is_known_surname(c, dictionary)) if dictionary else (lambda c: F.lit(False))
    p = F.col("name_parts")
    foreign = (F.size(p) >= 2) & (F.col("name_order") == 0) & ~known(F.get(p, F.lit(0))) & ~known(F.get(p, F.size(p) - 1)) if dictionary else F.lit(False)
    x = x.withColumn("is_non_chinese", F.coalesce(foreign, F.lit(False)))
    conf = F.when(F.col("is_non_chinese"), 0.3).when(F.exists("is_first_name_map", lambda v: v), 0.9).otherwise(0.5)
    label = F.when(F.col("name_order") == 1, LABELS[1]).when(F.col("name_order") == -1, LABELS[-1]).otherwise(LABELS[0])
    return x.withColumns({"detected_order": label, "confidence": conf})


def parsed(author: Column, order: Column) -> Column:
    """Struct surname, given_name, middle_name of an author whose order is known."""
    p = name_parts(author)
    n = F.size(p)
    at = lambda i: F.coalesce(F.get(p, i if isinstance(i, Column) else F.lit(i)), F.lit(""))
    joined = lambda start, length: F.array_join(F.slice(p, F.lit(start), F.greatest(length, F.lit(0))), " ")
    front = F.struct(at(0).alias("surname"), at(1).alias("given_name"), joined(3, n - 2).alias("middle_name"))
    back = F.struct(at(n - 1).alias("surname"), F.when(n > 1, at(0)).otherwise("").alias("given_name"), joined(2, n - 2).alias("middle_name"))
    return F.when(n > 0, F.when(order >= 0, front).otherwise(back))


def split_authors(c: Column) -> Column:
    """Authors of a list: at semicolons if it has one, else at commas."""
    s = t.clean_name(F.coalesce(c, F.lit("")))
    cut = F.when(s.rlike("[;；]"), F.split(s, "[;；]")).otherwise(F.split(s, "[,，]"))
    return F.filter(F.transform(cut, t.strip_space), lambda x: x != "")


def parse_lists(df: DataFrame, *, list_id: str = "list_id", authors: str = "authors", dictionary: dims.Dictionary | None = dims.DEFAULT) -> DataFrame:
    """A row for each author: list_id, position, author, order used, surname, given_name, middle_name, is_first_author.

    The first author keeps its own order; the others take the sign of the sum of the others' orders.
    A list without an id, or with one that others have too, votes for itself.
    """
    # lists that share an id are told apart by their text; lists alike in both have the same vote
    own = F.xxhash64(F.col(list_id), F.col(authors))
    x = df.select(F.col(list_id).alias("list_id"), own.alias("own"), F.posexplode(split_authors(F.col(authors))).alias("position", "author"))
    x = with_order(x, "author", dictionary=dictionary)
    # the vote stays with its list: one shuffle of numbers, joined back by list
    votes = x.filter("position > 0").groupBy("own").agg(F.signum(F.sum("name_order")).cast("int").alias("vote"))
    x = x.join(votes, "own", "left")
    used = F.when(F.col("position") == 0, F.col("name_order")).otherwise(F.coalesce("vote", F.lit(0)))
    x = x.withColumn("used_order", used).withColumn("parts", parsed(F.col("author"), F.col("used_order"))).filter(F.col("parts").isNotNull())
    return x.select("list_id", "position", "author", "used_order", "parts.*", (F.col("position") == 0).alias("is_first_author"))
