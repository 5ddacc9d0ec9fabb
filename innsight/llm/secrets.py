"""Secret scans with corpus-wide ownership frequency, in built-in functions only.

Three patterns give the base spans. Long tokens of mixed letters and digits are
candidates besides. The hash of every candidate's value is counted over the corpus
by distinct repositories and distinct owners: what many owners hold is a copied
example, what few hold looks like a live credential. Candidates of few owners are
added as spans; base spans stay whatever their frequency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.sources.scratch import stage_table

# The patterns and least lengths of the base spans, in their order.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"  # the run from the first AKIA on; a shorter run holds no longer one
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "generic")
# Long tokens that are no base span: a digit, a small and a capital letter in 24
# characters or more.
GENERIC = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+"
#: Values that so many owners and repositories hold are copied examples.
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 3
SPAN = (
    "struct<start:bigint,kind:int,stop:bigint,value:string,n_repositories:bigint,"
    "n_owners:bigint,copied:boolean>"
)

_SPANS = "array<struct<start:bigint,kind:int,stop:bigint,value:string>>"
#: Matches that are placed together: a running sum over a list copies it at each step,
#: so a list of n is summed in parts of this size, and the parts after them.
PLACED = 128


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _spans(text: Column, pattern: str, group: int, kind: int) -> Column:
    """Array of (start, kind, stop, value) of all matches, in code points.

    The text between matches and the matches alternate, so running sums of their
    lengths give every place: within parts of PLACED matches, and over the parts.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g).cast("long")).alias("gap"),
        F.transform(whole, lambda w: F.char_length(w).cast("long")).alias("length"),
        value.alias("value"),
    )

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        stop = start + x["length"]
        made = F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["value"].alias("value")
        )
        grown = F.concat(state["made"], F.array(made))
        return F.struct(stop.alias("at"), grown.alias("made"))

    zero = F.lit(0).cast("long")
    nothing = F.struct(zero.alias("at"), F.array().cast(_SPANS).alias("made"))

    def placed(steps: Column) -> Column:
        # the last gap is behind all matches
        starts = F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1)), F.lit(PLACED))
        parts = F.transform(
            starts,
            lambda i: F.aggregate(
                F.slice(steps, i, F.least(F.lit(PLACED), F.size(steps) - i)), nothing, step
            ),
        )
        return _let(parts, shifted)

    def shifted(parts: Column) -> Column:
        begin = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("made"))
        before = F.aggregate(
            parts,
            begin,
            lambda state, x: F.struct(
                (state["at"] + x["at"]).alias("at"),
                F.concat(state["made"], F.array(state["at"])).alias("made"),
            ),
            lambda state: state["made"],
        )
        moved = F.transform(
            F.arrays_zip(parts["made"].alias("made"), before.alias("by")),
            lambda part: F.transform(
                part["made"],
                lambda m: F.struct(
                    (m["start"] + part["by"]).alias("start"),
                    m["kind"].alias("kind"),
                    (m["stop"] + part["by"]).alias("stop"),
                    m["value"].alias("value"),
                ),
            ),
        )
        return F.flatten(moved)

    return F.when(text.rlike(pattern), _let(steps, placed)).otherwise(F.array().cast(_SPANS))


def _candidates(docs: DataFrame, doc_id: str, text: str, owner: Column, repository: Column):
    """A narrow row for each document, with a number of its own: all spans, generic ones
    too, their values as hashes."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(
        F.col(doc_id).alias("doc_id"),
        whole.alias("text"),
        owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"),
    )
    t = F.col("text")
    long_value = lambda s: F.char_length(s["value"]) >= ASSIGN_LEAST
    mixed = lambda s: (
        s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    )
    every = F.concat(
        F.filter(_spans(t, ASSIGN, 2, 0), long_value),
        _spans(t, ACCESS, 0, 1),
        _spans(t, HEX, 0, 2),
        F.filter(_spans(t, GENERIC, 0, 3), mixed),
    )
    hashed = F.transform(every, lambda s: s.withField("value", F.sha2(s["value"], 256)))
    return own.select(
        "doc_id", "owner", "repository", F.monotonically_increasing_id().alias("row"), hashed.alias("every")
    )


def _apart(spans: DataFrame) -> DataFrame:
    """The base spans, and the generic ones that meet none of their text.

    A sweep in the order of places: a generic span meets a base span that starts before
    its stop if the furthest stop of those lies beyond its start.
    """
    base = F.col("kind") < 3
    sweep = (
        Window.partitionBy("row")
        .orderBy(F.when(base, F.col("start")).otherwise(F.col("stop") - 1), (~base).cast("int"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reached = F.max(F.when(base, F.col("stop"))).over(sweep)
    marked = spans.withColumn("reached", reached)
    return marked.where(base | F.coalesce(F.col("reached") <= F.col("start"), F.lit(True))).drop("reached")


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, n_repositories, n_owners) of each candidate hash over the corpus.

    ``candidates`` has value, repository and owner. Repeats are gone before the
    count, on the map side, so a value that a third of the corpus holds is no
    single group. Rows without owner or repository add none.
    """
    triples = candidates.select("value", "repository", "owner").distinct()
    repositories = triples.where("repository is not null").select("value", "repository").distinct()
    owners = triples.where("owner is not null").select("value", "owner").distinct()
    marked = repositories.select("value", F.lit(1).alias("r"), F.lit(0).alias("o")).unionByName(
        owners.select("value", F.lit(0).alias("r"), F.lit(1).alias("o"))
    )
    return marked.groupBy("value").agg(
        F.sum("r").cast("long").alias("n_repositories"), F.sum("o").cast("long").alias("n_owners")
    )


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string")
            ),
        ),
        ",",
    )


def scan_secrets(
    docs: DataFrame,
    owner: Column,
    repository: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    copied_owners: int = COPIED_OWNERS,
    copied_repositories: int = COPIED_REPOSITORIES,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex,
    base (array of start, kind, stop, value hash, and the numbers of repositories and
    owners that hold the value), base_text, added (the same, of owner-specific generic
    tokens), spans (text of base and added), n_copied, n_live.

    Starts and stops are code points, the stop exclusive; spans are in order of
    start, then kind. A value that at least ``copied_owners`` owners and
    ``copied_repositories`` repositories hold is a copied example: n_copied counts
    such spans, base or generic, n_live all others. Null and empty texts have no
    spans. Repeated rows stay and agree; rows without owner or repository lend none,
    and a value that no row with both holds counts as live.

    Work is linear in the matches of a text, but for sorting them: every span is a
    row between the scan and the result.
    """
    found = stage_table(_candidates(docs, doc_id, text, owner, repository), "secrets")
    spans = _apart(found.select("row", "owner", "repository", F.inline("every")))
    held = ownership(spans.select("value", "repository", "owner"))
    known = spans.drop("owner", "repository").join(held, "value", "left").fillna(0, ["n_repositories", "n_owners"])
    copied = (F.col("n_owners") >= copied_owners) & (F.col("n_repositories") >= copied_repositories)
    span = F.struct("start", "kind", "stop", "value", "n_repositories", "n_owners", copied.alias("copied"))
    of_row = known.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("all"))  # of one document
    none = F.filter(F.array(F.lit(None).cast(SPAN)), lambda s: s.isNotNull())
    joined = found.select("doc_id", "row").join(of_row, "row", "left").withColumn("all", F.coalesce("all", none))
    of_kind = lambda kind: lambda s: s["kind"] == kind
    added = lambda s: (s["kind"] == 3) & ~s["copied"]
    kept = lambda s: (s["kind"] < 3) | ~s["copied"]
    n_copied = F.size(F.filter("all", lambda s: s["copied"])).cast("long")
    shown = lambda spans: F.transform(spans, lambda s: s.dropFields("copied"))
    base = F.filter("all", lambda s: s["kind"] < 3)
    return joined.select(
        "doc_id",
        *[
            F.size(F.filter("all", of_kind(k))).cast("long").alias(f"n_{name}")
            for k, name in enumerate(KINDS[:3])
        ],
        shown(base).alias("base"),
        _text(base).alias("base_text"),
        shown(F.filter("all", added)).alias("added"),
        _text(F.filter("all", kept)).alias("spans"),
        n_copied.alias("n_copied"),
        (F.size("all").cast("long") - n_copied).alias("n_live"),
    )
