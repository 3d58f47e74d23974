"""Weakly labelled entity samples: matches by pattern, merging, ranking, few-shot examples, names of places and forces."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matches(sentences: DataFrame, text: str, pattern: str, kind: str) -> DataFrame:
    """(text, entity) of each distinct sentence with a match: all matches in order, as structs (entity, entity_type). Null texts go."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    s = sentences.select(F.col(text).alias("text")).distinct().withColumn("found", found).where(F.size("found") > 0)
    return s.select("text", F.transform("found", lambda e: F.struct(e.alias("entity"), F.lit(kind).alias("entity_type"))).alias("entity"))


def entities(samples: DataFrame) -> DataFrame:
    return samples.select(F.explode("entity.entity").alias("entity")).distinct()


def merged(samples: DataFrame) -> DataFrame:
    """Samples of one text joined: their entities, and entity_type_count, the number of samples."""
    return samples.groupBy("text").agg(F.array_sort(F.flatten(F.collect_list("entity"))).alias("entity"), F.count(F.lit(1)).alias("entity_type_count"))


#: Texts are told by 128 bits and their first characters, so that none is dealt whole; so many entities that occur most often are held by every task.
HEAD, OFTEN = 128, 4096
ORDER = ["entity_type_count", "frequency", "entities", "kind", "longest"]


def told(text: Column) -> list[Column]:
    return [F.unhex(F.md5(text)).alias("id"), F.left(text, F.lit(HEAD)).alias("head")]


def facts_of(found: DataFrame) -> DataFrame:
    """(id, head, ORDER) of distinct texts (id, head, found: the entities of each kind), dealt by id, that have any.

    The rarity of a text that has one of the OFTEN entities is the greatest number of those; only texts without one meet the other entities by key.
    """
    every = F.flatten("found")
    some = F.transform("found", lambda x: F.size(x) > 0)
    d = found.select(
        "id", "head", F.size(F.filter(some, lambda x: x)).alias("entity_type_count"), F.size(every).alias("entities"), F.array_position(some, F.lit(True)).alias("kind"),
        F.array_max(F.transform(every, lambda x: F.length(x))).alias("longest"), F.explode(F.array_distinct(every)).alias("entity"),
    )
    own = ["id", "head", "entity_type_count", "entities", "kind", "longest"]
    often = found.select(F.explode(every).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("often"))
    most = often.orderBy(F.desc("often"), "entity").limit(OFTEN)
    first = d.join(F.broadcast(most), "entity", "left").groupBy(*own).agg(F.max("often").alias("frequency"))
    rest = first.where("frequency is null").select("id").hint("shuffle_hash")
    other = d.join(rest, "id").join(often, "entity").groupBy(*own).agg(F.max("often").alias("frequency"))
    return first.where("frequency is not null").unionByName(other).select("id", "head", *ORDER)


def foremost(facts: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of ``facts`` by order and head, with all that tie with the last of them: few, as they share the head too."""
    key = F.struct((-F.col("entity_type_count")).alias("a"), "frequency", (-F.col("entities")).alias("b"), "kind", "longest", "head")
    k = facts.withColumn("key", key)
    last = k.select("key").orderBy("key").limit(n).agg(F.max("key").alias("last"))
    return k.join(F.broadcast(last), F.col("key") <= F.col("last")).select("id", *ORDER)


def first_by(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.desc("entity_type_count"), "frequency", F.desc("entities"), "kind", "longest", "text").limit(n)


def ranked(samples: DataFrame, kinds: list[str], n: int) -> DataFrame:
    """The ``n`` samples (all, if fewer) that come first by: most kinds, rarest entity, most entities, first kind, shortest entity; then text.

    The rarity of a sample is the largest number of times that one of its entities occurs in all samples. Each text has at most one sample of a kind.
    """
    s = samples.select(*told(F.col("text")), "text", "entity")
    of = [F.transform(F.filter("e", lambda x: x["entity_type"] == F.lit(k)), lambda x: x["entity"]) for k in kinds]  # noqa: B023
    found = s.select("id", "head", "entity").groupBy("id", "head").agg(F.flatten(F.collect_list("entity")).alias("e")).select("id", "head", F.array(*of).alias("found"))
    m = s.join(F.broadcast(foremost(facts_of(found), n)), "id")
    return first_by(m.groupBy("text", *ORDER).agg(F.array_sort(F.flatten(F.collect_list("entity"))).alias("entity")), n)


def ranked_matches(sentences: DataFrame, text: str, patterns: dict[str, str], n: int) -> DataFrame:
    """``ranked`` of the ``matches`` of patterns by kind, in their order: (text, ORDER). Only entities and heads are dealt, no text is but the ``n`` and their ties."""
    t = sentences.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    found = F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in patterns.values()])
    d = t.select(*told(F.col("text")), found.alias("found")).repartition("id").distinct()
    near = F.broadcast(foremost(facts_of(d), n))
    return first_by(t.withColumn("id", told(F.col("text"))[0]).join(near, "id").select("text", *ORDER).distinct(), n)


def few_shot(examples: DataFrame, by: str, entity: str, output: str, every: list[str]) -> DataFrame:
    """One example an input: a map of each entity of ``every`` to its outputs, empty where it has none."""
    g = examples.groupBy(by, entity).agg(F.array_sort(F.collect_list(output)).alias("o"))
    m = g.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(entity, "o"))).alias("m"))
    pairs = [F.struct(F.lit(k).alias("k"), F.coalesce(F.col("m")[k], F.array().cast("array<string>")).alias("v")) for k in every]
    return m.select(by, F.map_from_entries(F.array(*pairs)).alias("output"))


def contained_or_related(rows: DataFrame, by: str, pos: str, marker: Column, prefix: str, link: str) -> DataFrame:
    """(by, contained, related): links of ``prefix`` after the marker row of their group are contained, those before it related."""
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("after", F.max(F.coalesce(marker, F.lit(False))).over(w)).where(F.startswith(F.col(link), F.lit(prefix)))
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col(link))))
    return r.groupBy(by).agg(pick(F.col("after")).alias("contained"), pick(~F.col("after")).alias("related"))


# Words that places and forces are named by, and the codes before a force's number.
PLACE_PREFIX_EN = ["Armed", "Biological", "Containment", "Dimensional", "Humanoid", "Exclusionary", "Extrasolar", "Lunar", "Protected", "Provisional", "Reliquary", "Research", "Storage", "Surveillance", "Mobile", "Bio", "Sat", "remote", "resource", "Parazoology"]
PLACE_PREFIX_CN = ["武装", "生物性", "生化", "收容", "维度性", "人形生物", "特外", "外太阳系", "月面", "受保护", "临时", "圣物", "圣遗物", "研究", "储藏", "监察", "移动", "测试", "历史", "生物", "观察", "前哨", "人形", "时间", "存储", "指挥", "附属", "概念", "安保", "模因", "异常动物学"]
PLACE_EN = ["Site", "Area", "Outpost", r"Observation[-\s]Post"]
PLACE_CN = ["站点", "区域", "前哨", "哨所", "区", "站", "哨"]
GREEK = ["Alpha", "Beta", "Chi", "Delta", "ETA", "Epsilon", "Eta", "Gamma", "Iota", "Kappa", "Lambda", "Mu", "Nu", "Omicron", "Phi", "Pi", "Psi", "Rho", "Sigma", "Stigma", "Tau", "Theta", "Upsilon", "Xi", "Zeta"]
STEMS, BRANCHES = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥"
FORCE_KINDS_CN, FORCE_WORDS_CN = ["机动", "联合", "应用", "混合", "协作"], ["特遣", "机动", "部", "小"]
FORCE_KINDS_EN = ["Mobile", "Applied", r"Armed\sMobile"]
FORCE_INITIALS = "mrsacotjp"


def any_of(patterns: list[str]) -> str:
    return "(?:" + "|".join(sorted(patterns, key=lambda p: (-len(p), p))) + ")"


def place_pattern() -> str:
    """Numbered places, with all words of kind before them: an English word takes a code with optional letters, a Chinese one needs a separator before its number.

    Words are tried longest first, so that a word of one character counts only where no longer one holds it; it needs a word of kind.
    """
    between, code = r"[-\s&]*(?:and[-\s]+)?", r"[0-9a-zα-ωΑ-Ω]+"
    english = f"(?:{any_of(PLACE_PREFIX_EN)}{between})*{any_of(PLACE_EN)}(?:[-\\s][a-zα-ωΑ-Ω]+)?(?:[-\\s]{code})(?:-{code})?".replace("\\\\", "\\")
    number = r"[-\s][0-9]+(?:[-\s][a-z]+)?(?:[-\s][0-9]+)?(?:[-\s][a-z]+)?"
    kinds, long, short = any_of(PLACE_PREFIX_CN), any_of([w for w in PLACE_CN if len(w) > 1]), any_of([w for w in PLACE_CN if len(w) == 1])
    chinese = f"(?:(?:{kinds}{between})*{long}|(?:{kinds}{between})+{short}){number}"
    return f"(?i)(?:{english}|{chinese})"


def force_patterns(names: list[str]) -> tuple[str, str]:
    """(with an affix, bare): numbered forces behind words or initials of a force, and official names alone; both with a quoted or bracketed alias, if one follows.

    Names are escaped; their dashes may be spaces or missing in a text.
    """
    official = [re.escape(n).replace(r"\-", r"[-\s]?") + "[0-9]*" for n in names if n]
    letters = [chr(c) for c in [*range(0x391, 0x3A2), *range(0x3A3, 0x3AA), *range(0x3B1, 0x3CA)]]
    coded = any_of([*GREEK, *letters, *(s + b for s in STEMS for b in BRANCHES)]) + r"[-\s]?[0-9]+"
    alias = r"(?:[-\s]?(?:[(（][^()（）]*[)）]|[“\"「][^”\"」]*[”\"」]))?"
    code = any_of([*official, coded])
    chinese = f"(?:{any_of(FORCE_KINDS_CN)})?{any_of(FORCE_WORDS_CN)}队[-\\s]?".replace("\\\\", "\\")
    english = f"(?:[{FORCE_INITIALS}]tf|(?:{any_of(FORCE_KINDS_EN)}\\s)?Task[-\\s]?Force)[-\\s]?".replace("\\\\", "\\")
    bare = f"(?i){any_of(official)}{alias}" if official else "(?!)"
    return f"(?i)(?:{chinese}|{english}){code}{alias}", bare


def trimmed(found: Column) -> Column:
    """Matches stripped, without those that end in a dash and those that are part of another."""
    from graphloom.functions.text import substring_eliminated

    clean = F.transform(F.filter(found, lambda m: ~F.endswith(m, F.lit("-"))), lambda m: F.trim(m))
    return substring_eliminated(F.filter(clean, lambda m: m != ""))


def places(text: Column) -> Column:
    """The distinct numbered places of a text, in order; null without a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(place_pattern()), F.lit(0)))


def forces(text: Column, names: list[str]) -> Column:
    """The forces of a text, repeats included: those with an affix; without any, the official names alone."""
    affixed, bare = force_patterns(names)
    found = F.regexp_extract_all(text, F.lit(affixed), F.lit(0))
    return trimmed(F.when(F.size(found) > 0, found).otherwise(F.regexp_extract_all(text, F.lit(bare), F.lit(0))))


def linked_sentences(records: DataFrame, links: list[str], pages: DataFrame, key: str, text: str, ends: str = "。！？") -> DataFrame:
    """The distinct sentences of the pages that any link array of ``records`` names."""
    from graphloom.functions.sentences import split_sentences

    every = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in links])
    wanted = records.select(F.explode(every).alias("s_link")).distinct()
    hit = pages.join(wanted, F.col(key) == F.col("s_link"), "left_semi")
    return hit.select(F.explode(split_sentences(F.col(text), ends)).alias("sentence")).distinct()
