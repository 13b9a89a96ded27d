"""Vocabularies of debating: stages, positions, formats, categories, motions."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, codes, ranks and patterns that published records use.
STAGE_RANKS = {"grand_final": 100, "final": 95, "semifinal": 90, "quarterfinal": 80, "octofinal": 70, "double_octofinal": 60, "triple_octofinal": 50}
STAGE_PATTERNS = [
    ("grand_final", r"grand\s*final|\bgf\b"),
    ("semifinal", r"semi[-\s]?final|\bsf\b|\bsemis?\b"),
    ("quarterfinal", r"quarter[-\s]?final|\bqf\b|\bquarters?\b"),
    ("triple_octofinal", r"triple\s*octo|\btriples?\b"),
    ("double_octofinal", r"partial|double\s*octo|\bdoubles?\b|round\s*of\s*32"),
    ("octofinal", r"octo[-\s]?final|\boctos?\b|round\s*of\s*16"),
    ("final", r"\bfinals?\b"),
]
SHORT_STAGES = {
    "gf": "Grand Final", "f": "Final", "sf": "Semifinals", "semis": "Semifinals", "qf": "Quarterfinals", "quarters": "Quarterfinals", "of": "Octofinals", "octos": "Octofinals",
    "dof": "Double Octofinals", "doubles": "Double Octofinals", "tof": "Triple Octofinals", "triples": "Triple Octofinals",
}
DISPLAY_STAGES = {"grand_final": "Final", "final": "Final", "semifinal": "Semifinals", "quarterfinal": "Quarterfinals", "octofinal": "Octofinals", "double_octofinal": "Double Octofinals", "triple_octofinal": "Triple Octofinals"}
INROUND_LABELS = [r"^\d+$", r"(?i)^round\s+\d+$", r"(?i)^r\d+$"]
OUTROUND_LABELS = [
    r"(?i)^(?:GF|F|SF|QF|OF|DOF|TOF)$",
    r"(?i)^(?:grand\s*finals?|finals?|semi[-\s]?finals?|quarter[-\s]?finals?|octo[-\s]?finals?|double\s*octo[-\s]?finals?|triple\s*octo[-\s]?finals?|partial\s*double[-\s]?octofinals?|partial\s*triple[-\s]?octofinals?|round\s*of\s*\d+)$",
    r"(?i)^(?:octos?|doubles?|triples?|quarters?|semis?)$",
]
POSITIONS = ["OG", "OO", "CG", "CO", "Prop", "Opp"]
POSITION_NAMES = {
    "og": "OG", "opening government": "OG", "1st proposition": "OG", "oo": "OO", "opening opposition": "OO", "1st opposition": "OO",
    "cg": "CG", "closing government": "CG", "2nd proposition": "CG", "co": "CO", "closing opposition": "CO", "2nd opposition": "CO",
    "prop": "Prop", "proposition": "Prop", "gov": "Prop", "government": "Prop", "aff": "Prop", "affirmative": "Prop", "opp": "Opp", "opposition": "Opp", "neg": "Opp", "negative": "Opp",
}
FORMATS = {"british parliamentary": "BP", "asian parliamentary": "AP", "world schools": "WSDC", "lincoln-douglas": "LD", "public forum": "PF", "policy": "Policy"}
CATEGORY_PRIORITY = {"Open": 100, "ESL": 80, "EFL": 60, "Novice": 50}
OTHER_PRIORITY = 40
MOTION_STEMS = [
    ("THBT", r"(?i)^(this house believes(\s+that)?\b|thbt?\.?\s)"),
    ("THW", r"(?i)^(this house would\b|thw\.?\s)"),
    ("THS", r"(?i)^(this house supports\b|ths\.?\s)"),
    ("THO", r"(?i)^(this house opposes\b|tho\.?\s)"),
    ("THR", r"(?i)^(this house regrets\b|thr\.?\s)"),
    ("THP", r"(?i)^(this house prefers\b|thp\.?\s)"),
    ("Other", r"(?i)^(this house|th\b)"),
]
REPORT_LABELS = {
    "wrong_teammate": "Wrong teammate", "wrong_speaker_rank": "Wrong speaker rank", "wrong_speaker_average": "Wrong speaker average", "wrong_team_result": "Wrong team result",
    "wrong_outround": "Wrong outround", "wrong_identity": "Didn't speak/judge here", "claimed_by_someone_else": "Someone claimed my identity", "other": "Other",
}
FIELD_SIZES = [(24, "Under 24 teams"), (48, "24–47 teams"), (100, "48–99 teams")]
LARGEST_FIELD = "100+ teams"


def lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])[key]


def normalize_stage(label: Column) -> Column:
    """Short codes in full: R3, GF, semis and the like; other labels trimmed."""
    bare = F.trim(label)
    number = F.regexp_extract(bare, r"(?i)^r(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("Round "), number.try_cast("bigint").cast("string"))).otherwise(F.coalesce(lookup(SHORT_STAGES, F.lower(bare)), bare))


def outround_stage(label: Column) -> Column:
    """Class of an elimination stage; the first pattern that fits wins."""
    low, out = F.lower(label), F.lit(None).cast("string")
    for name, pattern in reversed(STAGE_PATTERNS):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def stage_rank(label: Column, strict: bool = True, round_number: Column | None = None) -> Column:
    """How deep a stage is. Unknown labels: null if strict, else the round number or 0."""
    rank = lookup(STAGE_RANKS, outround_stage(label))
    return rank if strict else F.coalesce(rank, *([] if round_number is None else [round_number]), F.lit(0))


def round_class(label: Column) -> Column:
    """inround, outround or unknown."""
    bare = F.trim(label)
    is_any = lambda patterns: reduce(lambda a, b: a | b, (bare.rlike(p) for p in patterns))
    return F.when(is_any(INROUND_LABELS), F.lit("inround")).when(is_any(OUTROUND_LABELS), F.lit("outround")).otherwise(F.lit("unknown"))


def category_of(stage: Column) -> Column:
    """The break category that starts a stage label; Open if none does."""
    found = F.lower(F.regexp_extract(stage, r"(?i)^(open|esl|efl|novice)\b", 1))
    return F.when(found == "esl", F.lit("ESL")).when(found == "efl", F.lit("EFL")).when(found == "novice", F.lit("Novice")).otherwise(F.lit("Open"))


def strip_category(stage: Column) -> Column:
    return F.trim(F.regexp_replace(stage, r"(?i)^(open|esl|efl|novice)\s+", ""))


def category_priority(category: Column) -> Column:
    return F.when(category.isNull() | (category == ""), F.lit(0)).otherwise(F.coalesce(lookup(CATEGORY_PRIORITY, category), F.lit(OTHER_PRIORITY)))


def display_stage(stage: Column) -> Column:
    """For people: without category, grand final and final alike; other labels in full."""
    full = normalize_stage(stage)
    return F.coalesce(lookup(DISPLAY_STAGES, outround_stage(full)), full, F.lit(""))


def canonical_position(label: Column) -> Column:
    """Seat codes; labels outside the vocabulary stay as they are, trimmed."""
    key = F.lower(F.regexp_replace(F.trim(label), r"\s+", " "))
    return F.when(key == "", F.lit(None)).otherwise(F.coalesce(lookup(POSITION_NAMES, key), F.trim(label)))


def position_order(position: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(p) for p in POSITIONS]), position)
    return F.when(place > 0, place).otherwise(F.lit(len(POSITIONS) + 1))


def format_abbreviation(name: Column) -> Column:
    bare = F.trim(name)
    return F.when(bare != "", F.coalesce(lookup(FORMATS, F.lower(bare)), bare))


def motion_type(text: Column) -> Column:
    """The stem of a motion; Other for a house that does something else; null if no house is named."""
    bare, out = F.trim(text), F.lit(None).cast("string")
    for name, pattern in reversed(MOTION_STEMS):
        out = F.when(bare.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def field_size(teams: Column) -> Column:
    out = F.when(teams.isNull() | (teams <= 0), F.lit(None).cast("string"))
    for below, name in FIELD_SIZES:
        out = out.when(teams < below, F.lit(name))
    return out.otherwise(F.lit(LARGEST_FIELD))


def field_size_order(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(n) for _, n in FIELD_SIZES], F.lit(LARGEST_FIELD)), name)


def report_label(code: Column) -> Column:
    """Short label of a report's category; codes outside the list stay as they are."""
    return F.coalesce(lookup(REPORT_LABELS, code), code)


def report_labels(codes: Column) -> Column:
    """Labels of a report's categories in one line."""
    return F.array_join(F.transform(codes, report_label), "; ")
