"""Entries against registry records, and records against each other.

Records are one row (file_id, entry_seq, source, ord, title, authors array, year, volume, number, pages,
journal, doi, document_type).  All joins are on the entry's identity, so no side needs a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ID = ["file_id", "entry_seq"]
SOFT = ("year", "volume", "number", "pages")
#: Rows of a dimension of accepted forms.
MOST_FORMS = 20_000


def _soft(name: str, c: Column) -> Column:
    return T.norm_pages(c) if name == "pages" else F.lower(F.trim(F.regexp_replace(c.cast("string"), r"[{}]", "")))


def _pairs(value: dict[str, tuple[Column, Column]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("field"), a.alias("ours"), b.alias("theirs")) for n, (a, b) in value.items()])


def soft_field_diffs(entries: DataFrame, records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, key, source, field, ours, theirs): both given, unequal once normalised; a start page equals its range.

    ``keep``: further columns of the entries.
    """
    both = entries.join(records.select(*ID, "source", *[F.col(f).cast("string").alias(f"r_{f}") for f in SOFT]), ID)
    pairs = {f: (T.field(f), F.coalesce(F.col(f"r_{f}"), F.lit(""))) for f in SOFT}
    given = F.filter(_pairs(pairs), lambda d: (d["ours"] != "") & (d["theirs"] != "") & (d["ours"] != d["theirs"]))
    out = both.select(*ID, *keep, "key", "source", F.inline(given))
    norm = lambda c: F.when(F.col("field") == "pages", T.norm_pages(F.col(c))).otherwise(_soft("year", F.col(c)))
    out = T.once(out, a=norm("ours"), b=norm("theirs"))
    begins = (F.col("field") == "pages") & F.startswith(F.col("a"), F.concat("b", F.lit("-")))
    return out.filter((F.col("a") != F.col("b")) & ~begins).drop("a", "b")


def missing_fields(entries: DataFrame, records: DataFrame, names: tuple[str, ...] = ("doi", *SOFT)) -> DataFrame:
    """(id, key, source, field, suggested): given in the record, empty in the entry."""
    both = entries.join(records.select(*ID, "source", *[F.col(f).cast("string").alias(f"r_{f}") for f in names]), ID)
    found = F.explode(_pairs({f: (T.field(f), F.coalesce(F.col(f"r_{f}"), F.lit(""))) for f in names})).alias("d")
    out = both.select(*ID, "key", "source", found).filter((F.col("d.ours") == "") & (F.col("d.theirs") != ""))
    return out.select(*ID, "key", "source", "d.field", F.col("d.theirs").alias("suggested"))


def title_verdict(ours: Column, theirs: Column) -> Column:
    """One exclusive outcome for a pair of titles; null where nothing is to be said."""
    a, b = T.title_key(ours), T.title_key(theirs)
    share = T.overlap(T.words(a), T.words(b))
    plain = lambda c: F.regexp_replace(T.clean_tex(c), r"\s+", " ")
    squeezed = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    return (
        F.when((a == "") | (b == ""), None)
        .when(a == b, F.when(plain(ours) == plain(theirs), None).when(F.lower(plain(ours)) == F.lower(plain(theirs)), "casing").otherwise("punctuation"))
        .when(squeezed(a) == squeezed(b), "spacing")
        .when(T.shortened(a, b), "shortened")
        .when(share <= 0.1, "container")
        .when(share < 0.6, "strong")
        .otherwise("slight")
    )


def author_diffs(entries: DataFrame, records: DataFrame) -> DataFrame:
    """(id, key, source, first_differs, only_ours, only_theirs, reordered): names matched with their particles."""
    named = lambda c: F.transform(c, T.fold_surname)
    mine = T.once(entries.select(*ID, "key", T.field("author").alias("author")), ours=F.filter(named(T.authors(F.col("author"))), lambda x: x != ""), cut=T.truncated(F.col("author"))).drop("author")
    both = mine.join(T.once(records.select(*ID, "source", "authors"), theirs=named(F.col("authors"))).drop("authors"), ID)
    lacking = lambda a, b: F.filter(a, lambda x: ~F.exists(b, lambda y: T.surname_match(x, y)))
    both = T.once(both, first_differs=F.coalesce(~T.surname_match(F.try_element_at("ours", F.lit(1)), F.try_element_at("theirs", F.lit(1))), F.lit(False)))
    out = both.select(*ID, "key", "source", "first_differs", lacking(F.col("ours"), F.col("theirs")).alias("only_ours"), F.when(F.col("cut"), F.array().cast("array<string>")).otherwise(lacking(F.col("theirs"), F.col("ours"))).alias("only_theirs"), "ours", "theirs")
    same = (F.size("only_ours") == 0) & (F.size("only_theirs") == 0)
    return out.withColumn("reordered", same & (F.col("ours") != F.slice("theirs", 1, F.greatest(F.size("ours"), F.lit(1)))) & F.col("first_differs")).drop("ours", "theirs")


def cross_source_conflicts(entries: DataFrame, records: DataFrame) -> DataFrame:
    """(id, field, source_a, source_b, value_a, value_b): two sources disagree and the entry agrees with neither."""
    normal = lambda value: F.array(*[F.struct(F.lit(f).alias("field"), _soft(f, value(f)).alias("v")) for f in SOFT])
    mine = T.once(entries.select(*ID, "key", "fields"), own=normal(T.field)).drop("fields")
    rows = T.once(records.select(*ID, "source", "ord", *SOFT), vs=normal(lambda f: F.coalesce(F.col(f).cast("string"), F.lit(""))), given=F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) != "" for f in SOFT])).drop(*SOFT)
    left = rows.select(*ID, F.col("source").alias("source_a"), F.col("ord").alias("oa"), F.col("vs").alias("va"), F.col("given").alias("ga"))
    right = rows.select(*ID, F.col("source").alias("source_b"), F.col("ord").alias("ob"), F.col("vs").alias("vb"), F.col("given").alias("gb"))
    met = left.join(right, ID).filter(F.col("oa") < F.col("ob")).join(mine, ID)
    value = lambda c, i: F.get(c, F.lit(i))["v"]
    unlike = lambda i: F.get("ga", F.lit(i)) & F.get("gb", F.lit(i)) & (value("va", i) != value("vb", i)) & (value("own", i) != value("va", i)) & (value("own", i) != value("vb", i))
    found = F.array(*[F.when(unlike(i), F.struct(F.lit(f).alias("field"), value("va", i).alias("value_a"), value("vb", i).alias("value_b"))) for i, f in enumerate(SOFT)])
    return met.select(*ID, "key", "source_a", "source_b", F.inline(F.filter(found, lambda x: x.isNotNull()))).select(*ID, "key", "field", "source_a", "source_b", "value_a", "value_b")


def journal_verdict(ours: Column, theirs: Column) -> Column:
    """same, abbreviation, spelling, or different; null if either is empty."""
    a, b = T.title_key(ours), T.title_key(theirs)
    core = lambda k: F.regexp_replace(k, r"^the |\s*\([^)]*\)", "")
    return (
        F.when((a == "") | (b == ""), None)
        .when(core(a) == core(b), "same")
        .when(T.iso4(ours, theirs) | T.iso4(theirs, ours), "abbreviation")
        .when(F.levenshtein(a, b, 2) >= 0, "spelling")
        .otherwise("different")
    )


def closest_form(values: DataFrame, forms: DataFrame) -> DataFrame:
    """For (id, value): the nearest of all forms by edit distance, without braces and case; ties to the shorter, then in order.

    Forms are a dimension of at most ``MOST_FORMS`` rows, sent to every task as one row; more are refused.
    """
    if forms.limit(MOST_FORMS + 1).count() > MOST_FORMS:
        raise ValueError(f"more than {MOST_FORMS} forms: pass the dimension of one field")
    plain = lambda c: F.lower(F.regexp_replace(c, "[{}]", ""))
    every = forms.select("form").distinct().agg(F.array_sort(F.collect_list("form")).alias("forms"))
    nearest = F.array_min(F.transform("forms", lambda f: F.struct(F.levenshtein(plain(F.col("value")), plain(f)).alias("distance"), F.length(f).alias("size"), f.alias("form"))))
    met = values.join(F.broadcast(every), F.lit(True)).select("id", "value", nearest.alias("m"))
    return met.filter("m is not null").select("id", "value", "m.form", "m.distance")


def accepted_hits(wanted: DataFrame, hits: DataFrame, least: float = 0.8, most_hits: int = 8) -> DataFrame:
    """The first acceptable search hit of each entry: wanted (id, title, surname, year), hits (id, rank, title, surname, year, doi)."""
    ours = T.once(wanted.select("id", "surname", "year", "title"), a=T.title_key(F.col("title"))).drop("title").filter(F.size(T.words(F.col("a"))) >= 2)
    theirs = hits.filter(F.col("rank") <= most_hits).select("id", "rank", F.col("title").alias("ht"), F.col("surname").alias("hs"), F.col("year").alias("hy"), "doi")
    apart = F.abs(F.col("year") - F.col("hy"))
    # years and names go first, keys and words are made of what they leave
    both = ours.join(theirs, "id").filter((apart <= 3) & T.surname_match(F.col("surname"), F.col("hs")))
    a, b, unlike = F.col("a"), F.col("b"), (F.col("a") != F.col("b")) & (apart <= 1)
    both = T.once(both, b=T.title_key(F.col("ht")))
    both = T.once(both, wa=F.when(unlike, T.words(a)), wb=F.when(unlike, T.words(b)))
    both = T.once(both, share=F.when(unlike, T.overlap(F.col("wa"), F.col("wb"))), every=F.when(unlike, F.size(F.array_union("wa", "wb"))))
    near = (F.col("share") >= 0.9) | ((F.col("share") >= least) & (F.col("every") >= 8)) | T.shortened(a, b) | T.fragment(a, b)
    return both.filter((a == b) | (unlike & near)).groupBy("id").agg(F.min_by(F.struct("doi", "rank"), "rank").alias("m")).select("id", "m.doi", "m.rank")
