"""Text functions on columns: normalisers, classifiers, place and user text, masking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import vocabulary as V
from tallyloom.functions.dates import bound


def spaces(c: Column) -> Column:
    """White space runs become one space; trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def name_key(c: Column) -> Column:
    """A name without company syllables, brackets, dots and spaces, lower case. The class deletes single syllables too."""
    return F.lower(F.regexp_replace(c, V.NAME_NOISE, ""))


def address_key(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"[\s·.,-]", ""), F.lit(""))


def placeholder_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s./_()（）-]+", ""))


def brand_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^0-9a-zA-Z가-힣]+", ""))


def is_place_name(c: Column) -> Column:
    key = placeholder_key(c)
    return F.coalesce((key != "") & ~key.isin(*V.PLACEHOLDERS), F.lit(False))


def first_match(cases: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The value of the first case that holds: the order is part of the meaning."""
    return F.coalesce(*[F.when(c, F.lit(v)) for c, v in cases], F.lit(otherwise))


def chain_brand(c: Column, brands: tuple[tuple[str, tuple[str, ...]], ...] = V.BRANDS) -> Column:
    """The first listed brand of which an alias is contained."""
    key = brand_key(c)
    squeeze = lambda a: "".join(x for x in a.lower() if x.isalnum())
    return first_match([(reduce(lambda x, y: x | y, [key.contains(squeeze(a)) for a in aliases]), brand) for brand, aliases in brands])


def is_restaurant(code: Column, category: Column) -> Column:
    """The group code decides where there is one; else the category's hints; nothing known counts as yes."""
    hinted = category.rlike("|".join(V.RESTAURANT_HINTS))
    return F.when(code == V.FOOD_CODE, True).when(F.coalesce(code, F.lit("")) != "", False).when(F.coalesce(category, F.lit("")) == "", True).otherwise(hinted)


def region_part(address: Column) -> Column:
    """'<short region> <district>' of the first of three provinces that the address names."""
    out = []
    for short, pattern in V.REGION_PARTS:
        district = F.regexp_extract(address, pattern, 1)
        out.append(F.when(district != "", F.concat(F.lit(f"{short} "), district)))
    return F.coalesce(*out)


def place_parts(c: Column) -> Column:
    """STRUCT<name, address_hint>: a bracket at the very end holds the address."""
    value = spaces(c)
    pattern = r"^(.+?)\(([^()]+)\)\s*$"
    has = value.rlike(pattern)
    return F.struct(
        F.when(has, spaces(F.regexp_extract(value, pattern, 1))).otherwise(value).alias("name"),
        F.when(has, F.trim(F.regexp_extract(value, pattern, 2))).alias("address_hint"),
    )


def place_text(name: Column, address: Column, hint: Column, explicit: Column) -> Column:
    """Explicit text wins if it has a bracket or there is no name; else name, with its address in brackets."""
    empty_null = lambda c: F.nullif(spaces(c), F.lit(""))
    e, n, a = empty_null(explicit), empty_null(name), F.coalesce(empty_null(address), empty_null(hint))
    return F.when(e.isNotNull() & (e.rlike(r"[(（]") | n.isNull()), e).when(n.isNotNull() & a.isNotNull(), F.concat(n, F.lit("("), a, F.lit(")"))).otherwise(n)


def amount(c: Column) -> Column:
    """The digits alone: signs and decimal points are lost."""
    return F.regexp_replace(c, r"[^0-9]", "").try_cast("long")


def scaled_amount(c: Column, in_thousands: Column) -> Column:
    """Values under 10 000 under a thousands header are thousands."""
    n = amount(c)
    return F.when(in_thousands & (n < 10_000), n * 1000).otherwise(n)


def positive_digits(c: Column) -> Column:
    n = F.regexp_replace(c, r"[^0-9]", "").try_cast("int")
    return F.when(n > 0, n)


def party_size(c: Column, others: str = "외", people: str = "명인") -> Column:
    """'... others N people' is N + 1, 'N people' is N; what is not positive is NULL."""
    # a cast that fails raises an error inside, which costs more than all else of a row
    found = lambda pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("int")
    more = found(rf"{others}\s*([0-9]+)\s*[{people}]") + 1
    plain = found(rf"([0-9]+)\s*[{people}]")
    n = F.coalesce(more, plain)
    return F.when(n > 0, n)


def district_hint(department: Column) -> Column:
    d = F.regexp_extract(department, r"([가-힣]+구)(?:청|의회)?", 1)
    return F.when(d != "", F.concat(F.lit("서울 "), d))


def masked_names(c: Column, ranks: tuple[str, ...] = V.RANKS) -> Column:
    """A personal name before a rank becomes two circles; longer ranks are tried first."""
    return F.trim(F.regexp_replace(c, V.name_before_rank(ranks), "○○$2$3"))


def names_in_department(c: Column) -> Column:
    """Whether a department holds a personal name: unit names that end in two of the ranks are let through.

    A unit name is one without a gap before the rank whose stem is not three syllables long.
    """
    hits = F.regexp_extract_all(c, F.lit(V.name_before_rank(V.RANKS)), F.lit(0))
    unit = "|".join(V.UNIT_RANKS)
    is_unit = lambda h: h.rlike(rf"^(?:[가-힣]{{2}}|[가-힣]{{4}})(?:{unit})$")
    return F.coalesce(F.exists(hits, lambda h: ~is_unit(h)), F.lit(False))


def with_user_text(df: DataFrame, user: str, department: str, region: Column, phase: Column, own_names: Column) -> DataFrame:
    """Adds representative, rank_label, party_size and department of who spent.

    Elected ranks of the agency's region may show a name; institutions are no persons. own_names: the
    agency's names, without spaces. The steps are columns of their own, so that none is computed twice.
    """
    every = "|".join(sorted({r for v in V.ELECTED.values() for r in v}, key=lambda r: (-len(r), r)))
    table = F.create_map(*[x for k, v in V.ELECTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    c = F.col
    has_rank = lambda p: F.array_contains(c("_ranks"), F.regexp_extract(p, rf"({every})$", 1))
    steps = [
        ("_value", spaces(F.coalesce(user, F.lit("")))),
        ("_own", own_names),
        ("_ranks", F.when(phase.isin("p2", "p3", "p4"), F.array().cast("array<string>")).otherwise(F.element_at(table, region))),
        # the first pair whose rank is elected here, in text order
        ("_pair", F.get(F.filter(F.regexp_extract_all("_value", F.lit(rf"[가-힣]{{2,4}}\s*(?:{every})"), F.lit(0)), has_rank), F.lit(0))),
        ("_name", F.regexp_extract("_pair", rf"^([가-힣]{{2,4}}?)\s*(?:{every})$", 1)),
        ("_person", c("_pair").isNotNull() & ~institution(c("_name"), c("_own"))),
        ("_held", F.get(F.filter("_ranks", lambda r: F.contains(c("_value"), r)), F.lit(0))),
        ("_appointed", first_match([(c("_value").contains(r), V.LOW_RANK if r == V.STAFF else r) for r in V.APPOINTED], V.LOW_RANK)),
        ("rank_label", F.coalesce(F.when(c("_person"), F.regexp_extract("_pair", rf"({every})$", 1)), "_held", "_appointed")),
        ("representative", F.when(c("_person"), c("_name"))),
        ("party_size", party_size(c("_value"))),
        ("_dept", F.coalesce(F.nullif(F.trim(department), F.lit("")), F.lit(V.DEFAULT_DEPARTMENT))),
        ("_stem", F.trim(F.regexp_extract("_dept", rf"^(.+)\s+({every})$", 1))),
        ("_end", F.regexp_extract("_dept", rf"^(.+)\s+({every})$", 2)),
        ("_bare", F.when((c("_stem") != "") & F.array_contains("_ranks", c("_end")) & institution(c("_stem"), c("_own")), c("_stem")).otherwise(c("_dept"))),
        ("_low", c("_value").contains(V.STAFF) | (c("rank_label") == V.LOW_RANK)),
        (
            "department",
            F.when(F.array_contains("_ranks", c("rank_label")), c("_bare"))
            .when(c("_low") & ~c("_bare").contains(V.OTHERS), F.concat("_bare", F.lit(f" {V.OTHERS}")))
            .when(c("_low"), c("_bare"))
            .otherwise(c("_dept")),
        ),
    ]
    for name, value in steps:
        df = df.withColumn(name, value)
    return df.drop(*[name for name, _ in steps if name[0] == "_"])


def institution(c: Column, own_names: Column) -> Column:
    compact = F.regexp_replace(c, r"\s+", "")
    return compact.rlike("(?:" + "|".join(V.INSTITUTIONS) + ")$") | F.coalesce(F.array_contains(own_names, compact), F.lit(False))


def keyword_category(text: Column, keywords: dict[str, tuple[str, ...]], default: str) -> Column:
    """The category of which most keywords occur; ties go to the one listed first, none to the default."""
    keys, n = list(keywords), len(keywords)
    # a category's rank is its number of hits, then its place from the end: the greatest rank finds the key in a table
    table = [default] * n + keys[::-1] * max(len(words) for words in keywords.values())
    hits = lambda low, words: reduce(lambda a, b: a + b, [F.contains(low, F.lit(w.lower())).cast("int") for w in words])
    best = lambda low: F.greatest(F.lit(0), *[hits(low, words) * n + (n - 1 - i) for i, words in enumerate(keywords.values())])
    return bound(F.lower(text), lambda low: F.get(F.array(*map(F.lit, table)), best(low)))


def query_names(c: Column) -> Column:
    """Search names: the whole, its last two words, its last three; once each."""
    clean = spaces(F.regexp_replace(F.regexp_replace(c, r"[()（）㈜]", " "), r"(?<![\w가-힣])(?:" + "|".join(V.COMPANY_WORDS) + r")(?![\w가-힣])", " "))
    words = F.split(clean, " ")
    tail = lambda n: F.when(F.size(words) >= n, F.array_join(F.slice(words, -n, n), " "))
    # slice needs enough words; shorter lists give NULL before it is reached
    whole = F.nullif(clean, F.lit(""))
    return F.array_distinct(F.array_compact(F.array(whole, tail(2), tail(3))))


def common_hangul(a: Column, b: Column) -> Column:
    """Whether two names share enough distinct syllables (two, or fewer for shorter names); names without any pass."""
    ka, kb = F.regexp_replace(a, "[^가-힣]", ""), F.regexp_replace(b, "[^가-힣]", "")
    letters = lambda k: F.array_distinct(F.split(k, ""))
    need = F.least(F.lit(2), F.char_length(ka), F.char_length(kb))
    return (ka == "") | (kb == "") | (F.size(F.array_intersect(letters(ka), letters(kb))) >= need)


def query_free_url(c: Column, drop: tuple[str, ...] = ("page", "pageIndex", "token")) -> Column:
    """A URL's identity: session ids and the named parameters go."""
    bare = F.regexp_replace(c, r"(?i);jsessionid=[^?#]*", "")
    out = F.regexp_replace(bare, rf"(?i)(?<=[?&])(?:{'|'.join(drop)})=[^&#]*&?", "")
    return F.regexp_replace(out, r"[?&]+(?=#|$)", "")


def with_page(url: Column, page: Column, parameter: str = "page") -> Column:
    """The URL with its page parameter set: replaced where it stands, else added to the query."""
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    bare = F.regexp_replace(url, r"#.*$", "")
    held = rf"([?&]){parameter}=[^&]*"
    value = F.concat(F.lit(f"{parameter}="), page.cast("string"))
    added = F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), value)
    return F.concat(F.when(bare.rlike(held), F.regexp_replace(bare, F.lit(held), F.concat(F.lit("$1"), value))).otherwise(added), fragment)


def download_identity(url: Column) -> Column:
    """A download's URL without its one-time keys and fragment."""
    return query_free_url(F.regexp_replace(url, r"#.*$", ""), ("pkey", "token", "key"))


def holds_non_place_hint(name: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(name.contains(w), F.lit(False)) for w in V.NON_PLACE_HINTS])


def strictly_no_place(name: Column, outer_id: Column, lat: Column, lng: Column, status: Column) -> Column:
    """A name that reads like a purpose, with little else to show that it is a place; a long name shows nothing."""
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    phrase = F.regexp_replace(trimmed, r"\s+", "").rlike("|".join(V.PURPOSE_PHRASES))
    missing = lambda c: F.coalesce(c == 0, F.lit(True))
    weak = (F.coalesce(outer_id, F.lit("")) == "") | missing(lat) | missing(lng) | F.coalesce(status.isin("fail", "manual_review"), F.lit(False)) | (F.char_length(trimmed) >= 18)
    return phrase & weak


def place_queries(name: Column, road: Column, jibun: Column, part: Column) -> Column:
    """What to ask a map for a place, the most telling first, each once."""
    asked = [F.trim(F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(c, F.lit("")))) for c in (road, jibun, part)] + [F.trim(name)]
    return F.array_distinct(F.filter(F.array(*asked), lambda q: q != ""))


def agency_queries(name: Column, sub_region: Column, region: Column) -> Column:
    """What to ask a map for an agency: its name, with the regions that it lacks, and its works' offices."""
    lacks = lambda c: (F.coalesce(c, F.lit("")) != "") & ~name.contains(c)
    plain = [
        name,
        F.when(lacks(sub_region), F.concat_ws(" ", sub_region, name)),
        F.when(lacks(region), F.concat_ws(" ", region, name)),
        F.when(lacks(region) & lacks(sub_region), F.concat_ws(" ", region, sub_region, name)),
    ]
    offices = [F.when(name.contains(work), F.replace(name, F.lit(work), F.lit(office))) for work, names in V.WORKS_OFFICES.items() for office in names]
    return F.array_distinct(F.array_compact(F.array(*plain, *offices)))


def confidence(c: Column) -> Column:
    """A model's confidence: a number, or a word for one; nothing counts as the default, an unknown word as nothing."""
    word = F.lower(F.trim(c))
    table = F.create_map(*[F.lit(x) for kv in V.CONFIDENCE_LABELS.items() for x in kv])
    return F.when(c.isNull(), F.lit(V.DEFAULT_CONFIDENCE)).otherwise(F.coalesce(word.try_cast("double"), F.element_at(table, word)))


def day_label(c: Column) -> Column:
    """A day with dots; what is no day stays."""
    day = F.split_part(c, F.lit("T"), F.lit(1))
    return F.when(F.size(F.split(day, "-")) == 3, F.replace(day, F.lit("-"), F.lit("."))).otherwise(F.nullif(c, F.lit("")))


def grade_label(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in V.GRADE_LABELS.items() for x in kv]), c), F.lit(V.NEW_LABEL))


def short_region(c: Column) -> Column:
    """A region's own name, without that of the upper region around the capital."""
    return F.regexp_replace(F.trim(c), r"^(?:서울|경기|인천)\s+", "")


def reporter_fingerprint(forwarded: Column, remote: Column, agent: Column) -> Column:
    """Who reports, without saying so: a hash of the first forwarded address, else the remote one, and the agent."""
    first = F.nullif(F.trim(F.split_part(F.coalesce(forwarded, F.lit("")), F.lit(","), F.lit(1))), F.lit(""))
    return F.sha2(F.concat_ws(":", F.coalesce(first, remote, F.lit("")), F.coalesce(agent, F.lit(""))), 256)
