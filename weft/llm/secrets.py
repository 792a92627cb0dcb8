"""Secret scans told apart by corpus-wide ownership, with DataFrame functions only.

Four kinds of spans are found in whole texts. Three are rules (`assign`, `access`, `hex`) and always stay. The fourth,
`token`, is any long run of letters, digits and `_-` that mixes them like a random string; on its own that is only a
candidate. Candidates' hashes are counted over the corpus by distinct documents, repositories and owners, near-copies of
one document counting once, with one of their owners and repositories: a value that documents of several owners or of
many repositories hold is a copied example, any other one is live-looking. Only live-looking candidates
that overlap no rule's span become spans. Values of rule spans get the same verdict, which tells live-looking
credentials from copied examples among them; they stay spans either way.

Values are pre-aggregated by (value, document sketch) before anything meets; verdicts go back to documents through
a join on (value, salt), so a value that a third of the documents hold is spread over SALTS keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

#: Rules: kind, pattern, group that holds the value, least characters of that group. Fixed values.
RULES = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
TOKEN = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "token")
#: A value that more owners than this hold is a copied example.
OWNERS = 1
#: So is one that more repositories than this hold, be they of one owner.
REPOS = 2
#: Hashes of least value over three-word runs by which near-copies of a document are counted once.
SEEDS = 6
#: Least entropy of the characters in bits, and least share of neighbours of different kinds, of a random string that
#: has few digits.
ENTROPY, SWITCHES = 3.5, 0.35
SALTS = 16
#: Matches that are placed together; a text's places then take time in proportion to FOLD times its matches.
FOLD = 256


def _let(value: Column, f) -> Column:
    """f(value) with value worked out once: inside the lambdas of f an expression would be worked out for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, value>> of leftmost, non-overlapping matches whose group is long enough.

    Java's split keeps what stands between the matches, so lengths of pieces and matches add up to places."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1)) if group else whole
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(between, F.lit(1), F.size(whole)).alias("b"))
    firsts = lambda p: F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0)), F.lit(FOLD))
    parts = _let(pairs, lambda p: F.transform(firsts(p), lambda i: F.slice(p, i + 1, FOLD)))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value"))
        found = F.when(F.length(x["v"]) >= least, F.array_append(acc["found"], span)).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    def shifted(spans: Column, by: Column) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["value"].alias("value")),
        )

    def chain(acc: Column, part: Column) -> Column:
        return F.struct((acc["at"] + part["at"]).alias("at"), F.array_append(acc["found"], shifted(part["found"], acc["at"])).alias("found"))

    placed = F.transform(parts, lambda p: F.aggregate(p, empty, step))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("found"))
    return F.when(text.rlike(pattern), F.flatten(F.aggregate(placed, none, chain, lambda a: a["found"]))).otherwise(empty["found"])


def _random_looking(v: Column) -> Column:
    digits, lower, upper = (F.length(F.regexp_replace(v, c, "")) for c in ("[^0-9]", "[^a-z]", "[^A-Z]"))
    kinds = (lower > 0).cast("int") + (upper > 0).cast("int")
    distinct = F.size(F.array_distinct(F.split(v, "")))
    mixed = (digits >= 4) & (lower + upper >= 4) & (kinds >= 1) & (distinct >= 10)
    # Few digits: a random string changes often between lower case, upper case and digits, and is not words in camel case.
    plain = F.regexp_replace(v, "[_-]", "")
    runs = plain
    for kind, one in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0")):
        runs = F.regexp_replace(runs, kind, one)
    n = F.length(plain)
    share = lambda c: (n - F.length(F.replace(plain, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(plain, "")), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return mixed | ((n >= 16) & ~plain.rlike(r"^[a-z]*\d*([A-Z][a-z]+\d*)*$") & (F.length(runs) - 1 >= SWITCHES * (n - 1)) & (bits >= ENTROPY))


def _sketch(text: Column) -> Column:
    """array<long>: for each of SEEDS the least hash of the text's three-word runs."""
    at = lambda w, i: F.xxhash64(*(F.get(w, i + k) for k in range(3)))
    upto = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0)))
    runs = _let(F.split(F.lower(text), r"\s+"), lambda w: F.transform(upto(w), lambda i: at(w, i)))
    least = lambda r, seed: F.array_min(F.transform(r, lambda h: F.xxhash64(h, seed)))
    return _let(runs, lambda r: F.transform(F.array(*map(F.lit, range(SEEDS))), lambda seed: least(r, seed)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def _find(text: Column) -> tuple[Column, Column]:
    """(rule spans, candidate token spans that overlap none of them) of a text."""
    rules = F.array_sort(F.concat(*(_spans(text, k, p, g, n) for k, (_, p, g, n) in enumerate(RULES))))
    return rules, _spans(text, 3, TOKEN, 0, 20)


def _clear(tokens: Column, rules: Column) -> Column:
    return F.filter(
        tokens,
        lambda t: _random_looking(t["value"])
        & ~F.exists(rules, lambda r: (r["start"] < t["end"]) & (t["start"] < r["end"])),
    )


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_cols: tuple[str, ...] = ("source", "lang"),
    owners: int = OWNERS,
    carry: bool = False,
) -> DataFrame:
    """A row for each row of docs: doc_id, rules (its rule spans), live_rules (those of them that look live), added (its
    live-looking token spans), n_copied (candidates left out as copied examples); spans are structs (start, kind, end,
    value) in order. With carry, also the row of docs as struct `doc`.

    Null text is empty. A null owner is an owner of its own. Repeated rows are scanned each, and as copies of one
    document they do not make a value copied, whoever holds them. An empty table gives no rows; other columns are ignored.
    """
    rules, tokens = _find(F.coalesce(F.col(text_col), F.lit("")))
    repo = F.concat_ws("/", *(F.coalesce(F.col(c), F.lit("")) for c in repo_cols))
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(owner_col), F.lit("\0")).alias("owner"),
        repo.alias("repo"),
        F.monotonically_increasing_id().alias("row"),
        rules.alias("rules"),
        tokens.alias("tokens"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if carry else []),
    )
    found = found.withColumn("tokens", _clear(F.col("tokens"), F.col("rules")))
    found = found.withColumn("sketch", F.when(F.size("rules") + F.size("tokens") > 0, _sketch(F.col("body")))).drop("body")
    # Texts are scanned once; row numbers are fixed by being written.
    found = materialize(found)
    some = F.size("rules") + F.size("tokens") > 0
    hits = found.where(some).select("row", "owner", "repo", "sketch", F.explode(F.concat("rules", "tokens")).alias("t"))
    hits = hits.withColumn("hash", F.sha2(F.col("t.value"), 256))
    # Near-copies agree in one seed or more, so of the seeds the one that tells fewest documents apart counts.
    held = hits.select("hash", "owner", "repo", F.posexplode("sketch").alias("seed", "doc"))
    held = held.groupBy("hash", "seed", "doc").agg(F.min(F.struct("owner", "repo")).alias("at"))
    held = held.groupBy("hash", "seed", "at").agg(F.lit(1).alias("one")).groupBy("hash", "seed", "at.owner")
    held = held.agg(F.count("*").alias("repos")).groupBy("hash", "seed")
    owned = held.agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    owned = owned.groupBy("hash").agg(F.min("owners").alias("owners"), F.min("repos").alias("repos"))
    salted = owned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    judged = hits.join(salted, ["hash", "salt"])
    live = (F.col("owners") <= owners) & (F.col("repos") <= REPOS)
    token = F.col("t.kind") == F.lit(KINDS.index("token"))
    per_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(live & token, F.col("t")))).alias("added"),
        F.array_sort(F.collect_list(F.when(live & ~token, F.col("t")))).alias("live_rules"),
        F.count_if(~live & token).alias("n_copied"),
    )
    none = F.array().cast(_SPANS)
    clean = found.where(~some).select("*", none.alias("added"), none.alias("live_rules"), F.lit(0).cast("long").alias("n_copied"))
    out = found.where(some).join(per_row, "row").unionByName(clean)
    return out.select("doc_id", "rules", "live_rules", "added", "n_copied", *(["doc"] if carry else []))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with every run of overlapping spans (sorted by start) replaced by one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        between = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(fresh, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    end = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    return F.aggregate(spans, start, step, end)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every rule span and every live-looking token is replaced by a mark, and n_chars follows."""
    found = scan(docs, carry=True).select("doc", F.array_sort(F.concat("rules", "added")).alias("spans"))
    some = F.size("spans") > 0
    columns = []
    for f in docs.schema.fields:
        old = F.col("doc")[f.name]
        if f.name == "text":
            old = F.when(some, redact(old, F.col("spans"))).otherwise(old)
        elif f.name == "n_chars":
            old = F.when(some, F.length(redact(F.col("doc")["text"], F.col("spans")))).otherwise(old).cast(f.dataType)
        columns.append(old.alias(f.name))
    return found.select(*columns)


def _of(kind: int) -> Column:
    return F.size(F.filter("rules", lambda s: s["kind"] == kind)).cast("long")


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        _of(0).alias("n_assign"),
        _of(1).alias("n_access"),
        _of(2).alias("n_hex"),
        F.sha2(_joined(F.col("rules")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("rules", "added"))).alias("spans"),
        (F.size("live_rules") + F.size("added")).cast("long").alias("n_live"),
    )


QUERIES = {"op10_secret_ownership": op10_secret_ownership}
SQL: dict[str, str] = {}
