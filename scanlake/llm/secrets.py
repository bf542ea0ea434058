"""Secret scans with a trigram inverted index. DataFrame operations only.

Each rule's regular expression gives a Boolean query over trigrams that any match must hold. The index holds postings
(document, trigram) of the trigrams that some query asks for; a query is answered by intersecting postings per document,
and only the documents it leaves are read by the regular expression. A rule without mandatory trigrams reads them all.

Work on a text is about linear in its matches. Cases: null text counts as empty (no spans); null doc_id has no posting and is read by every rule; rows with the same
doc_id share the union of their postings, which is safe as every candidate is verified; an empty table gives an empty
table; extra columns are ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side, table


@dataclass(frozen=True)
class Rule:
    """A match of pattern counts if the given group has at least `least` characters. probe: a cheaper necessary pattern."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    probe: str = ""


SPANS = "array<struct<start:long,ord:int,stop:long,kind:string>>"
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True, r"[0-9a-f]{24}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[A-Za-z0-9_.~%-]+:[^\x20\x09-\x0D/@:]+@", 0, 10),
)

# --- Boolean trigram queries: ("all",) | ("tri", t) | ("and", [..]) | ("or", [..])
ALL = ("all",)
MOST_STRINGS, MOST_CLASS = 64, 6


def _and(parts):
    flat = list(dict.fromkeys(x for p in parts if p != ALL for x in (p[1] if p[0] == "and" else (p,))))
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _or(parts):
    parts = list(dict.fromkeys(parts))
    held = [set(_trigrams(p)) if p[0] == "tri" or p[0] == "and" and all(x[0] == "tri" for x in p[1]) else None for p in parts]
    parts = [p for p, h in zip(parts, held) if h is None or not any(o is not None and o < h for o in held)]  # what holds more than another adds nothing
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings):
    """The query of one of these strings, all of which are folded."""
    return _or([_and([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in strings])


def _class(items):
    """The characters of a small class, or None."""
    found = []
    for op, arg in items:
        if op is C.LITERAL:
            found.append(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < MOST_CLASS:
            found += [chr(x).lower() for x in range(arg[0], arg[1] + 1)]
        else:
            return None
    found = list(dict.fromkeys(found))
    return found if len(found) <= MOST_CLASS else None


def _walk(nodes):
    """(all strings the nodes can match or None, query of whatever they match)."""
    strings, asked = [""], []  # strings: of the run since the last break
    whole = True

    def broken():
        nonlocal strings, whole
        asked.append(_of_strings(strings))
        strings, whole = [""], False

    for op, arg in nodes:
        exact, query = None, ALL
        if op is C.LITERAL:
            exact = [chr(arg).lower()]
        elif op is C.IN:
            exact = _class(arg)
        elif op is C.SUBPATTERN:
            exact, query = _walk(arg[3])
        elif op is C.BRANCH:
            got = [_walk(x) for x in arg[1]]
            exact = [s for e, _ in got for s in e] if all(e is not None for e, _ in got) else None
            query = _or([q for _, q in got])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = arg
            e, q = _walk(inner)
            if most == 1 and least == 0 and e is not None:
                exact = ["", *e]
            elif least == most and e is not None and len(e) == 1:
                exact = [e[0] * least]
            query = q if least else ALL
            if exact is None and least and e is not None:  # at least one copy touches what stands before
                if len(strings) * len(e) <= MOST_STRINGS:
                    strings = [a + b for a, b in product(strings, e)]
        elif op is C.AT:
            exact = [""]
        if exact is not None and len(strings) * len(exact) <= MOST_STRINGS:
            strings = list(dict.fromkeys(a + b for a, b in product(strings, exact)))
            continue
        broken()
        asked.append(query)
        if exact is not None:
            strings = list(exact)
    if whole:
        return strings, _of_strings(strings)
    broken()
    return None, _and(asked)


def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression, over lower-cased text."""
    return _walk(list(_parser.parse(pattern)))[1]


def _trigrams(query) -> list[str]:
    return [query[1]] if query[0] == "tri" else [t for x in (query[1] if len(query) > 1 else ()) for t in _trigrams(x)]


def matches(query, text: str) -> bool:
    """The query on one text, for tests."""
    low = text.lower()
    return {"all": lambda: True, "tri": lambda: query[1] in low, "and": lambda: all(matches(x, text) for x in query[1]), "or": lambda: any(matches(x, text) for x in query[1])}[query[0]]()


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram: its number, doc_id), for every listed trigram that a document's lower-cased text holds."""
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(trigrams)])
    held = F.transform(F.array(F.lower("text")), lambda low: F.filter(asked, lambda x: F.contains(low, x["t"])))[0]
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.explode(held["i"]).alias("trigram"))


def candidates(index: DataFrame, trigrams: list[str], queries: dict[str, tuple]) -> DataFrame:
    """(doc_id, one Boolean per rule): the documents that some query leaves. Postings meet as bits, summed before the shuffle."""
    at = {t: i for i, t in enumerate(trigrams)}
    words = range((len(trigrams) + 62) // 63)
    bits = [F.bit_or(F.when(F.floor(F.col("trigram") / 63) == w, F.expr("shiftleft(1L, CAST(trigram % 63 AS INT))")).otherwise(F.lit(0).cast("long"))).alias(f"_m{w}") for w in words]
    masks = index.groupBy("doc_id").agg(*bits)

    def holds(q):
        if q[0] == "tri":
            i = at[q[1]]
            return F.col(f"_m{i // 63}").bitwiseAND(F.lit(1 << (i % 63)).cast("long")) != 0
        if q[0] == "and":
            out = F.lit(True)
            for x in q[1]:
                out = out & holds(x)
            return out
        out = F.lit(False)
        for x in q[1]:
            out = out | holds(x)
        return out

    flags = {k: holds(q) for k, q in queries.items()}
    some = F.lit(False)
    for x in flags.values():
        some = some | x
    return masks.where(some).select("doc_id", *[x.alias(f"_c_{k}") for k, x in flags.items()])


def bound(x, f):
    """f of column x, which is evaluated once."""
    return F.transform(F.array(x), f)[0]


def between(values, start, stop):
    """Column: elements start .. stop of an array (null if there are none), at the cost of those alone (slice() reads the whole array)."""
    at = F.sequence(start.cast("int"), stop.cast("int") - 1)
    return F.when(stop > start, F.transform(at, lambda k: F.get(values, k)))


def running(values, chunk: int = 256):
    """Column: array<struct<sum, top>> for an array<struct<n: long, top: long>>: sums of n and the greatest top before each element.

    Arrays grow within chunks and over the chunks' totals only, so the work is about linear in the array.
    """
    last = lambda n: F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / chunk).cast("long"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("top"))
    blank = F.array().cast("array<struct<sum:long,top:long>>")
    add = lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), F.greatest(a["top"], x["top"]).alias("top"))
    join = lambda a, x: F.struct((a["sum"] + x["sum"]).alias("sum"), F.greatest(a["top"], x["top"]).alias("top"))

    def scan(items, start, step):
        grow = lambda acc, x: F.struct(step(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))
        return F.aggregate(items, F.struct(start.alias("now"), blank.alias("out")), grow, lambda acc: acc["out"])

    def of(v):
        chunks = F.transform(last(F.size(v)), lambda i: between(v, i * chunk, F.least(i * chunk + chunk, F.size(v))))
        totals = lambda c: F.transform(c, lambda x: F.aggregate(x, zero, add))
        each = lambda c: F.zip_with(c, scan(totals(c), zero, join), lambda x, z: scan(x, z, add))
        return F.when(F.size(v) > 0, F.flatten(bound(chunks, each))).otherwise(blank)

    return bound(values, of)


def spans(text, rule: Rule, order: int):
    """Column: array<struct<start, ord, stop, kind>> of the rule's matches in text, leftmost first, without overlap.

    The gaps between matches (split) and the matches themselves (extract) give the offsets.
    """
    length = lambda x: F.transform(x, lambda y: F.length(y).cast("long"))
    whole = length(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    gaps = length(F.split(text, rule.pattern, -1))
    part = length(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))) if rule.group else None
    blank = F.array().cast(SPANS)

    def of(rows):  # m: match, b: the gap before it, g: what must have `least` characters
        steps = F.transform(rows, lambda x: F.struct((x["b"] + x["m"]).alias("n"), F.lit(0).cast("long").alias("top")))

        def hit(x, before):
            start = before["sum"] + x["b"]
            long = F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + x["m"]).alias("stop"), F.lit(rule.kind).alias("kind"))
            return F.when((x["g"] if rule.group else x["m"]) >= rule.least, long)

        return F.filter(F.zip_with(rows, running(steps), hit), lambda x: x.isNotNull())

    columns = [whole.alias("m"), gaps.alias("b"), *([part.alias("g")] if rule.group else [])]
    rows = F.filter(F.arrays_zip(*columns), lambda x: x["m"].isNotNull())  # the gap after the last match has none
    return F.when(F.regexp_like(text, F.lit(rule.probe or rule.pattern)), bound(rows, of)).otherwise(blank)


BITS = 1 << 27


def possible(flagged: DataFrame) -> DataFrame:
    """One row, _bits: array<long> of BITS bits, those that the doc_ids of flagged hash to. Its size is fixed, whatever flagged's."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    words = flagged.select(F.floor(at / 64).alias("w"), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(doc_id), {BITS}L) % 64 AS INT))").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).groupBy((F.floor(F.col("w") / 4096)).alias("page")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("w") % 4096).alias("k"), "b"))).alias("m"))
    page = words.select("page", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(4095).cast("long")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long"))).alias("v"))
    every = page.sparkSession.range(BITS // 64 // 4096).select(F.col("id").alias("page")).join(page, "page", "left")
    full = every.select("page", F.coalesce("v", F.array_repeat(F.lit(0).cast("long"), 4096)).alias("v"))
    return full.agg(F.sort_array(F.collect_list(F.struct("page", "v"))).alias("p")).select(F.flatten(F.col("p.v")).alias("_bits"))


def scan(docs: DataFrame, rules=RULES, max_bytes: int = 32 << 20) -> DataFrame:
    """docs with every column and _spans: array<struct<start, ord, stop, kind>> by start, then rule.

    Texts are read twice, for postings and for verification. Flags of candidates go to the texts by broadcast up to max_bytes;
    beyond, a bitmap of fixed size tells the texts that may be candidates, and only those are joined by doc_id.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ALL}
    trigrams = list(dict.fromkeys(t for q in queries.values() for t in _trigrams(q)))
    flagged = materialize(candidates(postings(docs.select("doc_id", "text"), trigrams), trigrams, queries), "secrets-candidates")
    text = F.coalesce(F.col("text"), F.lit(""))

    def read(rows: DataFrame, left: dict) -> DataFrame:
        each = []
        for i, r in enumerate(rules):
            asked = left.get(r.kind, F.lit(True))
            if asked is not None:  # None: no row is a candidate
                each.append(F.when(asked, spans(text, r, i)).otherwise(F.array().cast(SPANS)))
        found = F.array_sort(F.concat(*each)) if each else F.array().cast(SPANS)
        return rows.select(*docs.columns, found.alias("_spans"))

    flags = {k: F.coalesce(F.col(f"_c_{k}"), F.col("doc_id").isNull()) for k in queries}
    small = small_side(flagged, max_bytes)
    if small is not flagged:
        return read(docs.join(small, "doc_id", "left"), flags)
    bits = materialize(possible(flagged), "secrets-bits")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    word = F.get("_bits", F.floor(at / 64).cast("int"))
    may = F.coalesce(F.expr(f"shiftright(_w, CAST(pmod(xxhash64(doc_id), {BITS}L) % 64 AS INT)) & 1") != 0, F.lit(False))
    rows = docs.crossJoin(F.broadcast(bits)).withColumn("_w", word).withColumn("_may", may).drop("_bits", "_w")
    without = read(rows.where("NOT _may AND doc_id IS NOT NULL"), dict.fromkeys(queries))
    null = read(docs.where("doc_id IS NULL"), {})
    return without.unionByName(null).unionByName(read(rows.where("_may").drop("_may").join(flagged, "doc_id", "left"), flags))


def pieces_of(text, size: int = 256):
    """Column: text in pieces of `size` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def cut(pieces, start, stop, size: int = 256):
    """Column: characters start .. stop of the text whose pieces_of these are."""
    i, j = F.floor(start / size).cast("int"), F.floor(stop / size).cast("int")
    head = lambda n: F.substring(F.get(pieces, i), (start % size + 1).cast("int"), n)
    apart = F.concat(head(F.lit(size)), F.coalesce(F.array_join(between(pieces, i + 1, j), ""), F.lit("")), F.coalesce(F.substring(F.get(pieces, j), F.lit(1), (stop % size).cast("int")), F.lit("")))
    return F.when(stop <= start, "").when(i == j, head((stop - start).cast("int"))).otherwise(apart)


def redact(docs: DataFrame, rules=RULES, mark: str = "[secret]") -> DataFrame:
    """docs with each secret's span replaced by mark (overlapping spans by one mark); other columns stay.

    Null and empty texts, and texts without secrets, stay as they are; so do null and repeated doc_ids, row by row.
    """
    found = scan(docs, rules)

    def of(pieces):
        steps = F.transform("_spans", lambda s: F.struct(F.lit(0).cast("long").alias("n"), s["stop"].alias("top")))
        kept = F.zip_with("_spans", running(steps), lambda s, b: F.when(s["start"] >= b["top"], F.concat(cut(pieces, b["top"], s["start"]), F.lit(mark))))
        end = F.array_max(F.transform("_spans", lambda s: s["stop"]))
        return F.concat(F.array_join(kept, ""), cut(pieces, end, F.length("text").cast("long")))

    text = F.when(F.size("_spans") > 0, bound(pieces_of(F.col("text")), of)).otherwise(F.col("text"))
    return found.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def _joined(found):
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op8_secrets(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("_spans", "spans")
    base = F.filter("spans", lambda s: s["ord"] < sum(r.base for r in RULES))
    count = lambda k: F.size(F.filter("spans", lambda s: s["ord"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
