"""Data-quality detectors.  Each takes Tables and returns issues of one schema; DETECTORS lists them in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.dates import parse_date
from ..functions.similarity import can_reach, ratio, round2
from ..plans.tables import Tables
from ..sources.files import written

ISSUE_COLUMNS = ("issue_type", "severity", "entity_type", "entity_ids", "confidence", "impact_score", "explanation_json")


def issues(d: DataFrame, kind: str, severity: str | Column, entity: str | Column, ids: Column, confidence, impact, **explain: Column) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    about = F.to_json(F.struct(*[v.alias(k) for k, v in explain.items()])) if explain else F.lit("{}")
    return d.select(
        F.lit(kind).alias("issue_type"), lit(severity).alias("severity"), lit(entity).alias("entity_type"), ids.cast("array<int>").alias("entity_ids"),
        lit(confidence).cast("double").alias("confidence"), lit(impact).cast("double").alias("impact_score"), about.alias("explanation_json"),
    )


def _ids(*names: str) -> Column:
    return F.array(*[F.col(n) for n in names])


# ---- pairs ---------------------------------------------------------------------------------------------------------------

#: Rows of a key that meet in one task; a key of more is cut into sub-blocks of about so many.
BLOCK = 1000


def block_pairs(d: DataFrame, key: list[str], order: str, block: int | None = None) -> DataFrame:
    """The pairs of rows that agree in key, each once, as columns <name>_a and <name>_b with order_a < order_b.

    A key of many rows is cut into sub-blocks by hashes of order, as many as its counted size asks for, and each pair of sub-blocks,
    with themselves too, is a group of its own: a row goes to the groups of its sub-block and the later ones on the left, of its
    sub-block and the earlier ones on the right.  So a key of n rows makes tasks of like size, n / block of them for every row.
    """
    rest = [c for c in d.columns if c not in key]
    sizes = d.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / (block or BLOCK)).cast("int").alias("_blocks")).filter("_blocks > 1")
    x = d.join(sizes, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64(order), F.col("_blocks")).cast("int"))
    row = F.struct(*rest)
    left = x.select(*key, F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_j"), row.alias("_l"))
    right = x.select(*key, F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i"), F.col("_own").alias("_j"), row.alias("_r"))
    first = F.col("_l")[order] < F.col("_r")[order]
    met = left.join(right, [*key, "_i", "_j"]).filter(F.when(F.col("_i") == F.col("_j"), first).otherwise(F.col("_l")[order] != F.col("_r")[order]))
    met = met.withColumns({"_a": F.when(first, F.col("_l")).otherwise(F.col("_r")), "_b": F.when(first, F.col("_r")).otherwise(F.col("_l"))})
    return met.select(*key, *[F.col(f"_{s}")[c].alias(f"{c}_{s}") for s in "ab" for c in rest])


#: What an equal birth year, a close death year and an equal place add to half the similarity of the names.
BORN, DIED, PLACE = 0.25, 0.1, 0.15


def _person_groups(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(groups, members): persons of equal surname and name by what they can meet in, both written here.

    Persons with a birth year meet in it, those without one in an equal place and in death years at most one apart, which the
    score asks of them: each way to meet is a group key (kind, value) of its own.  A group is cut into parts of about BLOCK members.
    """
    p = t.persons.select(
        "id", X.norm_name(F.col("surname")).alias("last"), X.first_year(F.col("birth_date")).alias("born"), X.first_year(F.col("death_date")).alias("died"),
        F.concat(X.norm_name(F.col("given")), F.lit(" "), X.norm_name(F.col("surname"))).alias("name"), X.norm_place(F.col("birth_place")).alias("place"),
    )
    way = lambda kind, when: F.when(when, F.struct(F.lit(kind).alias("kind"), F.col(kind).cast("string").alias("value")))
    none = F.col("born").isNull()
    ways = F.array_compact(F.array(way("born", ~none), way("place", none & (F.col("place") != "")), way("died", none & F.col("died").isNotNull())))
    rows = written(p.withColumn("way", F.explode(ways)).select("last", "way.*", "name", "id", "born", "died", "place"), "people")
    key = ["last", "kind", "value", "name"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    groups = written(sizes.withColumn("group", F.monotonically_increasing_id()), "people-groups")
    members = rows.join(groups, key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return groups, members.select("group", "part", "id", "born", "died", "place")


def _met_groups(groups: DataFrame, least: float) -> DataFrame:
    """(kind, group_a, name_a, n_a, parts_a, group_b, ...): pairs of groups, each with itself too, whose members meet and whose names are
    of lengths that can be similar enough.  Death years meet the next one as well."""
    side = lambda d, s: d.select("last", "kind", "value", *[F.col(c).alias(f"{c}_{s}") for c in rest])
    rest = ["group", "name", "n", "parts"]
    own = groups.select("last", "kind", "value", *[F.col(c).alias(f"{c}_{s}") for s in "ab" for c in rest])
    died = groups.filter("kind = 'died'")
    later = side(died.withColumn("value", (F.col("value").cast("int") + 1).cast("string")), "a").join(side(died, "b"), ["last", "kind", "value"])
    met = block_pairs(groups, ["last", "kind", "value"], "group").unionByName(own).unionByName(later)
    return met.drop("last", "value").filter(can_reach(F.col("name_a"), F.col("name_b"), least))


def _member_pairs(met: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of members of met groups, each once with id_a < id_b, and extra, what they score besides their names.  turned tells that a
    is of the second group."""
    own = F.col("group_a") == F.col("group_b")
    d = met.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)))
    d = d.withColumn("part_b", F.explode(F.sequence(F.when(own, F.col("part_a")).otherwise(0), F.col("parts_b") - 1)))
    d = d.withColumn("halved", own & (F.col("part_a") == F.col("part_b"))).drop("parts_a", "parts_b", "n_a", "n_b")
    side = lambda s: members.select(F.col("group").alias(f"group_{s}"), F.col("part").alias(f"part_{s}"), F.struct("id", "born", "died", "place").alias(f"_{s}"))
    d = d.join(side("a"), ["group_a", "part_a"]).join(side("b"), ["group_b", "part_b"])
    of = lambda s, c: F.col(f"_{s}")[c]
    d = d.filter(F.when(F.col("halved"), of("a", "id") < of("b", "id")).otherwise(of("a", "id") != of("b", "id")))
    same_place = (of("a", "place") != "") & (of("a", "place") == of("b", "place"))
    d = d.filter((F.col("kind") != "died") | ~same_place)  # such a pair has met in its place
    extra = F.when(F.abs(of("a", "born") - of("b", "born")) <= 1, BORN).otherwise(0.0) + F.when(F.abs(of("a", "died") - of("b", "died")) <= 1, DIED).otherwise(0.0) + F.when(same_place, PLACE).otherwise(0.0)
    turned = of("a", "id") > of("b", "id")
    sides = {f"{c}_{s}": F.when(turned, of(o, c)).otherwise(of(s, c)) for s, o in ("ab", "ba") for c in ("id", "born", "died", "place")}
    names = {f"name_{s}": F.when(turned, F.col(f"name_{o}")).otherwise(F.col(f"name_{s}")) for s, o in ("ab", "ba")}
    return d.withColumns(sides | names | {"extra": extra, "turned": turned}).drop("_a", "_b", "group_a", "group_b", "part_a", "part_b", "halved")


def person_candidates(t: Tables, least: float = 0.68) -> DataFrame:
    """Pairs of persons of equal surname and birth year whose names are of lengths that can be similar enough.

    The other half of the score is checked here too: without a birth year a pair needs an equal place or a close death.  Names are
    compared once for each pair of groups of equal names; then every pair of persons that is made is a result.
    """
    groups, members = _person_groups(t)
    return _member_pairs(_met_groups(groups, least), members).drop("turned", "kind")


def similarities(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, sim_ab, sim_ba): the ratio of every different pair of strings, in either order.

    The pairs are written before and after: else a filter on the ratio is moved below distinct, and every row of pairs is compared.
    """
    different = written(pairs.select(a, b).distinct(), "different")
    return written(different.withColumns({"sim_ab": ratio(a, b), "sim_ba": ratio(b, a)}), "similarities")


def _similar_groups(groups: DataFrame) -> DataFrame:
    """Met groups with the similarity of their names in either order (sim_ab, sim_ba), where some members can score enough."""
    met = written(_met_groups(groups, 0.68), "people-met")
    names = similarities(met, "name_a", "name_b")
    best, most = F.greatest("sim_ab", "sim_ba"), F.when(F.col("kind") == "born", BORN + DIED + PLACE).when(F.col("kind") == "place", DIED + PLACE).otherwise(DIED)
    return met.join(names, ["name_a", "name_b"]).filter((best >= 0.68) & (best * 0.5 + most >= 0.55 - 1e-9))


def _scored(met: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of members of similar groups with sim and score, where both are high enough."""
    d = _member_pairs(met, members).withColumn("sim", F.when(F.col("turned"), F.col("sim_ba")).otherwise(F.col("sim_ab")))
    return d.withColumn("score", F.col("sim") * 0.5 + F.col("extra")).filter("sim >= 0.68 and score >= 0.55")


def duplicate_people(t: Tables) -> DataFrame:
    groups, members = _person_groups(t)
    met = written(_similar_groups(groups), "people-similar")
    # similarities and scores are few different numbers, however many pairs have them: they are rounded once each
    extras = F.array(*[F.lit(b) + F.lit(d) + F.lit(p) for b in (0.0, BORN) for d in (0.0, DIED) for p in (0.0, PLACE)])
    sims = met.select(F.explode(F.array("sim_ab", "sim_ba")).alias("sim")).distinct()
    scores = sims.withColumn("score", F.explode(F.transform(extras, lambda x: F.col("sim") * 0.5 + x))).distinct()
    scores = scores.withColumns({"confidence": round2("score"), "sim2": round2("sim")})
    scored = _scored(met, members).join(F.broadcast(scores), ["sim", "score"])
    return issues(
        scored, "duplicate_person", "warning", "person", _ids("id_a", "id_b"), F.col("confidence"), 1.0, name_similarity=F.col("sim2"),
        birth_delta=F.abs(F.col("born_a") - F.col("born_b")), death_delta=F.abs(F.col("died_a") - F.col("died_b")),
        birth_place_match=(F.col("place_a") != "") & (F.col("place_a") == F.col("place_b")),
    )


def _couples(t: Tables) -> DataFrame:
    f = t.families.filter("husband_person_id is not null and wife_person_id is not null")
    return f.select(
        "id", "husband_person_id", "wife_person_id", F.array_sort(F.array("husband_person_id", "wife_person_id")).alias("pair"), "marriage_date", "marriage_place",
        X.first_year(F.col("marriage_date")).alias("year"), X.norm_place(F.col("marriage_place")).alias("place"),
    )


def _family_pairs(c: DataFrame, key: list[str]) -> DataFrame:
    pairs = block_pairs(c, key, "id")
    same_year = F.coalesce(F.col("year_a") == F.col("year_b"), F.lit(False))
    same_place = (F.col("place_a") != "") & (F.col("place_a") == F.col("place_b"))
    return pairs.withColumns({"agree": same_year.cast("int") + same_place.cast("int")}).filter("agree >= 1")


def _family_issues(d: DataFrame, kind: str, base: float, **more: Column) -> DataFrame:
    both = lambda c: F.array(f"{c}_a", f"{c}_b")
    score = F.round(F.lit(base) + 0.15 * F.col("agree"), 2)
    return issues(d, kind, "info", "family", _ids("id_a", "id_b"), score, 1.0, **more, marriage_dates=both("marriage_date"), marriage_places=both("marriage_place"))


def duplicate_families(t: Tables) -> DataFrame:
    """Families of the same two spouses, in either role, with an equal marriage year or place."""
    return _family_issues(_family_pairs(_couples(t), ["pair"]), "duplicate_family", 0.7, spouses=F.col("pair"))


def duplicate_families_swapped(t: Tables) -> DataFrame:
    """Families of spouses of equal names but other ids, with an equal marriage year or place."""
    name = F.trim(F.concat(X.norm_name(F.col("given")), F.lit(" "), X.norm_name(F.col("surname"))))
    names = t.persons.select("id", name.alias("name"))
    c = _couples(t)
    for role in ("husband", "wife"):
        c = c.join(names.select(F.col("id").alias(f"{role}_person_id"), F.col("name").alias(role)), f"{role}_person_id").filter(F.col(role) != "")
    c = c.withColumn("names", F.array_sort(F.array("husband", "wife"))).drop("husband", "wife", "husband_person_id", "wife_person_id")
    pairs = _family_pairs(c, ["names"]).filter("pair_a <> pair_b")
    return _family_issues(pairs, "duplicate_family_spouse_swap", 0.6, spouse_names=F.col("names"), family_ids=_ids("id_a", "id_b"))


def duplicate_media_links(t: Tables) -> DataFrame:
    g = t.media_links.groupBy("asset_id", "person_id", "family_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).filter("n > 1")
    return issues(g, "duplicate_media_link", "info", "media_link", F.col("ids"), 0.9, F.col("n"), asset_id=F.col("asset_id"), person_id=F.col("person_id"), family_id=F.col("family_id"))


#: Characters that names of asset_candidates must begin with alike, and the longest names that meet by what is left of them after deletions.
HEAD, SHORT = 4, 20


def shortened(s: Column, k: int, head: int = 0) -> Column:
    """What is left of a string after k deletions behind its first head characters, each once."""
    out = F.array(s)
    for _ in range(k):
        cut = lambda x: F.transform(F.sequence(F.lit(head + 1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        out = F.array_distinct(F.flatten(F.transform(F.filter(out, lambda x: F.length(x) > head), cut)))
    return out


def _deletions(least: float, head: int) -> dict[tuple[int, int], tuple[list[int], list[int]]]:
    """For (i, j), deletions from the longer and from the shorter of two short strings that make them equal: the lengths that either may have."""
    lengths: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    for longer in range(SHORT + 1):
        for i in range(1, longer - head + 1):
            for j in range(i + 1):
                shorter = longer - i + j
                if shorter >= head and i + j <= (1 - least) * (longer + shorter) + 1e-9:
                    for kept, n in zip(lengths.setdefault((i, j), ([], [])), (longer, shorter), strict=True):
                        kept.append(n)
    return lengths


def similar_forms(forms: DataFrame, least: float, head: int = 0) -> DataFrame:
    """(form_a, form_b), a < b: different strings whose longest common subsequence allows a ratio of least; with head, those that begin
    with so many equal characters.

    Strings that share so much become equal after a few deletions, so short ones meet in what is left of them: each pair that meets is
    a result, and no pair is lost.  Longer strings, of which deletions leave too many, meet in their rarest characters (prefix_index), or
    in their head.
    """
    d = forms.withColumn("len", F.length("form"))
    parts = []
    for (i, j), (longer, shorter) in _deletions(least, head).items():
        left = d.filter(F.col("len").isin(longer)).select(F.col("form").alias("x"), "len", F.explode(shortened(F.col("form"), i, head)).alias("left"))
        right = d.filter(F.col("len").isin(shorter)).select(F.col("form").alias("y"), (F.col("len") + (i - j)).alias("len"), F.explode(shortened(F.col("form"), j, head)).alias("left"))
        parts.append(left.join(right, ["len", "left"]).filter(F.col("x") < F.col("y") if i == j else F.lit(True)).select(F.least("x", "y").alias("form_a"), F.greatest("x", "y").alias("form_b")))
    rest = d.filter(F.col("len") > SHORT * least / (2 - least) - 1e-9).select(F.col("form").alias("norm"), "len")
    index = rest.withColumn("token", F.substring("norm", 1, head)) if head else prefix_index(rest.select("norm"), least)
    index = index.join(index.filter(F.col("len") > SHORT).select("token").distinct(), "token", "left_semi")
    parts.append(index_pairs(index, least, SHORT).select(F.col("norm_a").alias("form_a"), F.col("norm_b").alias("form_b")))
    return reduce(DataFrame.unionByName, parts).distinct()


def index_pairs(index: DataFrame, least: float, over: int = 0) -> DataFrame:
    """(norm_a, norm_b, len_a, len_b), a < b: strings that share a token of an index (norm, len, token, and prefix where a string has several)
    and can be similar enough by lengths and characters, where one is longer than over."""
    met = block_pairs(index, ["token"], "norm").filter((F.greatest("len_a", "len_b") > over) & can_reach(F.col("norm_a"), F.col("norm_b"), least))
    if "prefix" in index.columns:  # a pair may share several tokens: it counts where the first of them is
        met = met.filter(F.col("token") == F.array_intersect("prefix_a", "prefix_b")[0])
    return met.filter(common_letters(letters(F.col("norm_a")), letters(F.col("norm_b")), F.col("len_a") + F.col("len_b"), least)).select("norm_a", "norm_b", "len_a", "len_b")


def _asset_pairs(t: Tables, form: Column, least: float, head: int = 0) -> DataFrame:
    """Pairs of assets, as of block_pairs, whose forms, made of norm, are equal or similar."""
    m = t.media_assets.select("id", F.col("original_filename").alias("file"), X.norm_filename(F.col("original_filename")).alias("norm"), F.col("size_bytes").alias("size")).filter("norm <> ''")
    m = written(m.withColumn("form", form), "assets")
    equal = block_pairs(m, ["form"], "id").drop("form")
    side = lambda s: m.select(F.col("form").alias(f"form_{s}"), F.struct("id", "file", "norm", "size").alias(f"_{s}"))
    near = similar_forms(m.select("form").distinct(), least, head).join(side("a"), "form_a").join(side("b"), "form_b")
    first = F.col("_a")["id"] < F.col("_b")["id"]
    near = near.select(F.when(first, F.col("_a")).otherwise(F.col("_b")).alias("_a"), F.when(first, F.col("_b")).otherwise(F.col("_a")).alias("_b"))
    return equal.unionByName(near.select(*[F.col(f"_{s}")[c].alias(f"{c}_{s}") for s in "ab" for c in ("id", "file", "norm", "size")]))


def asset_candidates(t: Tables, least: float = 0.92) -> DataFrame:
    """Pairs of assets whose file names start alike and share so many characters, in any order, that they can be similar enough."""
    tail = F.array_sort(F.split(F.substring(F.col("norm"), HEAD + 1, 1_000_000), ""))
    return _asset_pairs(t, F.concat(F.substring("norm", 1, HEAD), F.array_join(tail, "")), least, HEAD)


ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 ,"


def letters(s: Column) -> Column:
    """How often each character of the alphabet stands in a string, and how many others."""
    return F.array(*[F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit(""))) for ch in ALPHABET], F.length(F.regexp_replace(s, f"[{ALPHABET}]", "")))


def common_letters(a: Column, b: Column, total: Column, least: float) -> Column:
    """False only where the characters that two strings share (by their letters) keep the ratio under least: a bound of all matching blocks."""
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return 2 * shared >= F.lit(least) * total


def duplicate_media_assets(t: Tables) -> DataFrame:
    """Assets of similar names, however these begin."""
    d = _asset_pairs(t, F.col("norm"), 0.92).withColumn("sim", ratio("norm_a", "norm_b")).filter("sim >= 0.92")
    close = (F.col("size_a") > 0) & (F.col("size_b") > 0) & (F.abs(F.col("size_a") - F.col("size_b")) / F.greatest("size_a", "size_b") <= 0.02)
    d = d.withColumns({"confidence": round2(F.least(F.col("sim") + F.when(close, 0.1).otherwise(0.0), F.lit(0.99))), "sim2": round2("sim")})
    return issues(d, "duplicate_media_asset", "info", "media_asset", _ids("id_a", "id_b"), F.col("confidence"), 1.0, filenames=F.array("file_a", "file_b"), sizes=F.array("size_a", "size_b"), similarity=F.col("sim2"))


# ---- places --------------------------------------------------------------------------------------------------------------

def place_counts(t: Tables) -> DataFrame:
    """(value, n, first, norm): distinct place strings of events, births and deaths, in the order they are met."""
    e = t.events.select(F.lit(0).alias("rank"), F.col("id"), F.lit(0).alias("field"), F.col("place_raw").alias("value"))
    p = t.persons.select(F.lit(1).alias("rank"), "id", F.posexplode(F.array("birth_place", "death_place")).alias("field", "value"))
    some = e.unionByName(p).filter("value <> ''")
    g = some.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", "id", "field")).alias("first"))
    return g.withColumn("norm", X.norm_place(F.col("value")))


def place_variants(t: Tables) -> DataFrame:
    """(norm, variants, refs, canonical, listed) for normal forms with more than one spelling; the most frequent first, then the first met."""
    g = place_counts(t).groupBy("norm").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("refs"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "first", "value", "n"))).alias("all"))
    g = g.filter("variants > 1")
    return g.select("norm", "variants", "refs", F.col("all")[0]["value"].alias("canonical"), F.transform("all", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count"))).alias("listed"))


def place_clusters(t: Tables) -> DataFrame:
    return issues(place_variants(t), "place_cluster", "info", "place", F.array(), 0.65, F.col("refs"), canonical_suggestion=F.col("canonical"), variants=F.col("listed"))


def prefix_index(norms: DataFrame, least: float) -> DataFrame:
    """(norm, len, prefix, token): the prefix of each string's characters that a string similar enough must share one of.

    A ratio of least needs at least least * (len + len') / 2 common characters, counted with their repeats, and len' is no less
    than least / (2 - least) of len.  Characters with occurrence numbers (the second e is another token than the first) make sets of
    the strings.  In the order of how few strings hold them, two sets with so much in common share a token among the first
    len - needed + 1 of either one: no pair is lost, and strings meet in rare tokens first.
    """
    letters_ = F.array_sort(F.split("norm", ""))
    tokens = F.transform(letters_, lambda c, i: F.concat(c, (i - F.array_position(letters_, c) + 2).cast("string")))
    d = norms.select("norm", F.length("norm").alias("len"), tokens.alias("tokens"))
    each = d.select("norm", "len", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("strings"))  # characters times repeats: a small table
    needed = F.ceil(F.lit(least / (2 - least)) * F.col("len") - 1e-9)
    ordered = each.join(often, "token").groupBy("norm", "len").agg(F.array_sort(F.collect_list(F.struct("strings", "token"))).alias("all"))
    prefix = F.slice(F.transform("all", lambda x: x["token"]), F.lit(1), (F.col("len") - needed + 1).cast("int"))
    return ordered.select("norm", "len", prefix.alias("prefix")).withColumn("token", F.explode("prefix"))


def place_candidates(t: Tables, least: float = 0.8) -> DataFrame:
    """Pairs of places of different normal forms that can be similar enough: by shared rare characters, lengths, then all characters."""
    c = written(place_counts(t).filter("norm <> ''").select("value", "n", "first", "norm"), "places")
    met = index_pairs(prefix_index(c.select("norm").distinct(), least), least)
    sides = lambda s: c.select(*[F.col(x).alias(f"{x}_{s}") for x in c.columns])
    both = met.unionByName(met.select(F.col("norm_b").alias("norm_a"), F.col("norm_a").alias("norm_b"), F.col("len_b").alias("len_a"), F.col("len_a").alias("len_b")))
    pairs = both.join(sides("a"), "norm_a").join(sides("b"), "norm_b")
    return pairs.filter(F.struct(F.lower("value_a"), F.col("first_a")) < F.struct(F.lower("value_b"), F.col("first_b")))


def similar_places(t: Tables) -> DataFrame:
    pairs = place_candidates(t)
    norms = similarities(pairs, "norm_a", "norm_b").select("norm_a", "norm_b", F.col("sim_ab").alias("sim")).filter("sim >= 0.8")
    d = pairs.join(norms, ["norm_a", "norm_b"]).withColumn("sim2", round2("sim"))
    rank = lambda s: F.struct(-F.col(f"n_{s}"), -F.length(f"value_{s}"), F.lower(f"value_{s}"))
    item = lambda s: F.struct((-F.col(f"n_{s}")).alias("m"), F.lower(f"value_{s}").alias("l"), F.col(f"value_{s}").alias("value"), F.col(f"n_{s}").alias("count"))
    listed = F.transform(F.array_sort(F.array(item("a"), item("b"))), lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count")))
    best = F.when(rank("a") <= rank("b"), F.col("value_a")).otherwise(F.col("value_b"))
    return issues(d, "place_similarity", "info", "place", F.array(), F.col("sim2"), F.col("n_a") + F.col("n_b"), canonical_suggestion=best, variants=listed, similarity=F.col("sim2"))


# ---- fields --------------------------------------------------------------------------------------------------------------

def name_suggestions(t: Tables) -> DataFrame:
    """(id, given, surname, given_to, surname_to, reasons, fields): names to change; placeholders are passed over."""
    p = t.persons.select("id", "given", "surname", X.suggest_name(F.col("given")).alias("g"), X.suggest_name(F.col("surname")).alias("s"))
    change = lambda s, c: (F.size(F.col(s)["reasons"]) > 0) & ~X.norm_name(F.col(c)).isin(*X.PLACEHOLDERS)
    p = p.withColumns({"gc": change("g", "given"), "sc": change("s", "surname")}).filter("gc or sc")
    none = F.array().cast("array<string>")
    return p.select(
        "id", "given", "surname", F.when(F.col("gc"), F.col("g.suggestion")).alias("given_to"), F.when(F.col("sc"), F.col("s.suggestion")).alias("surname_to"),
        F.array_sort(F.array_distinct(F.concat(F.when(F.col("gc"), F.col("g.reasons")).otherwise(none), F.when(F.col("sc"), F.col("s.reasons")).otherwise(none)))).alias("reasons"),
        (F.col("gc").cast("int") + F.col("sc").cast("int")).alias("fields"),
    )


def field_standardization(t: Tables) -> DataFrame:
    d = name_suggestions(t)
    confidence = F.when(F.array_contains("reasons", "title_case"), 0.8).otherwise(0.9)
    return issues(d, "field_standardization", "info", "person", _ids("id"), confidence, F.col("fields"), given=F.col("given_to"), surname=F.col("surname_to"), reasons=F.col("reasons"))


def date_normalizations(t: Tables) -> DataFrame:
    """(entity_type, entity_id, field, raw_value, normalized, precision, qualifier, confidence, is_ambiguous) of all dates."""
    p = t.persons.select(F.lit("person").alias("entity_type"), F.col("id").alias("entity_id"), F.posexplode(F.array("birth_date", "death_date")).alias("pos", "raw_value"))
    p = p.select("entity_type", "entity_id", F.when(F.col("pos") == 0, "birth_date").otherwise("death_date").alias("field"), "raw_value")
    e = t.events.select(F.lit("event").alias("entity_type"), F.col("id").alias("entity_id"), F.lit("date_raw").alias("field"), F.col("date_raw").alias("raw_value"))
    some = p.unionByName(e).filter("raw_value <> ''").withColumn("d", parse_date(F.col("raw_value")))
    return some.select("entity_type", "entity_id", "field", "raw_value", "d.normalized", "d.precision", "d.qualifier", "d.confidence", F.col("d.ambiguous").alias("is_ambiguous"))


def date_issues(t: Tables) -> DataFrame:
    d = date_normalizations(t)
    severity = F.when(F.col("is_ambiguous"), "error").when(F.col("entity_type") == "person", "warning").otherwise("info")
    return issues(d, "date_normalization", severity, F.col("entity_type"), _ids("entity_id"), F.col("confidence"), 1.0, field=F.col("field"), raw=F.col("raw_value"), normalized=F.col("normalized"), precision=F.col("precision"), qualifier=F.col("qualifier"), ambiguous=F.col("is_ambiguous"))


# ---- integrity -----------------------------------------------------------------------------------------------------------

def _lives(t: Tables) -> DataFrame:
    return t.persons.select("id", X.first_year(F.col("birth_date")).alias("born"), X.first_year(F.col("death_date")).alias("died"))


def orphan_events(t: Tables) -> DataFrame:
    return issues(t.events.filter("person_id is null and family_id is null"), "orphan_event", "error", "event", _ids("id"), 0.9, 1.0)


def orphan_families(t: Tables) -> DataFrame:
    alone = t.families.filter("husband_person_id is null and wife_person_id is null").join(t.family_children.select(F.col("family_id").alias("id")), "id", "left_anti")
    return issues(alone, "orphan_family", "warning", "family", _ids("id"), 0.85, 0.5)


def impossible_timelines(t: Tables) -> DataFrame:
    return issues(_lives(t).filter("died < born"), "impossible_timeline", "error", "person", _ids("id"), 0.95, 1.0, birth=F.col("born"), death=F.col("died"))


def _parent_child(t: Tables) -> DataFrame:
    lives = _lives(t)
    r = t.relationships.join(lives.select(F.col("id").alias("parent_person_id"), F.col("born").alias("parent_born"), F.col("died").alias("parent_died")), "parent_person_id")
    return r.join(lives.select(F.col("id").alias("child_person_id"), F.col("born").alias("child_born")), "child_person_id", "left")


def young_parents(t: Tables) -> DataFrame:
    d = _parent_child(t).filter("parent_born > child_born - 12")
    return issues(d, "parent_child_age", "warning", "relationship", _ids("parent_person_id", "child_person_id"), 0.8, 0.8, parent_birth=F.col("parent_born"), child_birth=F.col("child_born"))


def late_children(t: Tables) -> DataFrame:
    d = _parent_child(t).filter("parent_died < child_born")
    return issues(d, "parent_child_death", "warning", "relationship", _ids("parent_person_id", "child_person_id"), 0.85, 0.8, parent_death=F.col("parent_died"), child_birth=F.col("child_born"))


def _marriages(t: Tables) -> DataFrame:
    f = t.families.select(F.col("id").alias("family_id"), X.first_year(F.col("marriage_date")).alias("wed"), F.explode(F.array("husband_person_id", "wife_person_id")).alias("id"))
    return f.filter("id is not null and wed is not null").join(_lives(t), "id")


def early_marriages(t: Tables) -> DataFrame:
    return issues(_marriages(t).filter("wed < born + 12"), "marriage_too_early", "warning", "family", _ids("family_id", "id"), 0.8, 0.7, marriage=F.col("wed"), birth=F.col("born"))


def late_marriages(t: Tables) -> DataFrame:
    return issues(_marriages(t).filter("wed > died"), "marriage_after_death", "warning", "family", _ids("family_id", "id"), 0.85, 0.7, marriage=F.col("wed"), death=F.col("died"))


def placeholder_names(t: Tables) -> DataFrame:
    d = t.persons.filter(X.norm_name(F.col("given")).isin(*X.PLACEHOLDERS) | X.norm_name(F.col("surname")).isin(*X.PLACEHOLDERS))
    return issues(d, "placeholder_name", "warning", "person", _ids("id"), 0.8, 0.2, given=F.col("given"), surname=F.col("surname"))


DETECTORS = {
    "duplicate_person": duplicate_people, "field_standardization": field_standardization, "place_cluster": place_clusters, "place_similarity": similar_places,
    "duplicate_family": duplicate_families, "duplicate_family_spouse_swap": duplicate_families_swapped, "duplicate_media_link": duplicate_media_links,
    "duplicate_media_asset": duplicate_media_assets, "date_normalization": date_issues, "orphan_event": orphan_events, "orphan_family": orphan_families,
    "impossible_timeline": impossible_timelines, "parent_child_age": young_parents, "parent_child_death": late_children,
    "marriage_too_early": early_marriages, "marriage_after_death": late_marriages, "placeholder_name": placeholder_names,
}
DUPLICATES = ("duplicate_person", "duplicate_family", "duplicate_family_spouse_swap", "duplicate_media_link", "duplicate_media_asset")
PLACES = ("place_cluster", "place_similarity")
INTEGRITY = ("orphan_event", "orphan_family", "impossible_timeline", "parent_child_age", "parent_child_death", "marriage_too_early", "marriage_after_death", "placeholder_name")


def run_detection(t: Tables, kinds: list[str] | None = None) -> DataFrame:
    """All issues with ids in the order of the detectors; add a detector by adding to DETECTORS."""
    names = kinds or list(DETECTORS)
    parts = [DETECTORS[n](t).withColumn("rank", F.lit(i)) for i, n in enumerate(names)]
    return reduce(DataFrame.unionByName, parts).withColumn("status", F.lit("open"))


def number_issues(found: DataFrame, after: int = 0) -> DataFrame:
    """Issue ids from after + 1 on, by detector, entity ids and explanation.

    The issues are written once, so detection runs once, when this is called.  Then they are put in order over ranges, which tasks
    sort and write by themselves; the number of issues ahead of each range is one row a range.
    """
    order = ["rank", "entity_ids", "explanation_json"]
    kept = written(found, "issues")
    place = {"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    d = written(kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(place), "issues-in-order")
    sizes = d.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    return d.join(ahead, "part").withColumn("id", F.lit(after) + F.col("ahead") + F.col("at") + 1).drop("ahead", "at", "part", "rank")


def scan(t: Tables, stored: DataFrame | None = None, kinds: list[str] | None = None, incremental: bool = False, detected_at: str | None = None) -> DataFrame:
    """Numbered issues with detected_at after a scan, which runs here: stored ones are dropped, or, incrementally, kept before the new ones."""
    time = F.to_timestamp_ntz(F.lit(detected_at)) if detected_at else F.localtimestamp()
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if incremental and stored is not None else 0
    new = number_issues(run_detection(t, kinds), int(top)).withColumn("detected_at", time)
    return stored.unionByName(new) if incremental and stored is not None else new


def scan_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))


def summary(found: DataFrame, dates: DataFrame) -> DataFrame:
    """The score and its parts, over open issues."""
    n = lambda kinds: F.count(F.when(F.col("issue_type").isin(*kinds) & (F.col("status") == "open"), 1))
    i = found.agg(n(DUPLICATES).alias("unresolved_duplicates"), n(PLACES).alias("place_clusters"), n(INTEGRITY).alias("integrity_warnings"), n(("field_standardization",)).alias("standardization_suggestions"))
    d = dates.agg(F.count(F.lit(1)).alias("total"), F.count("normalized").alias("good"))
    both = i.withColumn("k", F.lit(1)).join(d.withColumn("k", F.lit(1)), "k").drop("k")  # one row each
    pct = F.when(F.col("total") > 0, F.bround(F.col("good") / F.col("total") * 100, 1)).otherwise(0.0)
    share = lambda w, c: F.lit(w) * (F.lit(1.0) / (F.col(c) + 1))
    score = F.lit(0.4) * (F.col("standardized_dates_pct") / 100) + share(0.3, "unresolved_duplicates") + share(0.2, "place_clusters") + share(0.1, "integrity_warnings")
    both = both.withColumn("standardized_dates_pct", pct)
    return both.select(F.bround(score * 100, 1).alias("data_quality_score"), "standardized_dates_pct", "unresolved_duplicates", "place_clusters", "integrity_warnings", "standardization_suggestions")
