"""Personal data by weak supervision.

1. Four base kinds (email, ip, card, phone) are found by fixed patterns and checks; they always stand.
2. Wider candidates (unchecked digit groups, assigned secrets, national phone numbers, disguised addresses, account
   and social-security numbers) are cut out by one more pattern. Six labelers vote on each, yes, no or nothing:
   pattern shape, checksum, a gazetteer of cue words before it, assignment or quotes around it, variety of its
   characters, and counter-evidence (currency, units, decimals).
3. Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability and each kind's
   rate, without any labels. The table of counts is small by construction: 3^6 patterns a kind at most, however many
   rows there are; only it reaches the driver.
4. The posteriors, as soft labels, train the final span classifier: naive Bayes over the span's features (kind,
   length, share of digits, neighbouring characters) and votes. It is again learned from counts, and applied as a
   SQL expression. Spans of it that overlap a base span are dropped.

Positions are code points, end exclusive. Everything is Spark SQL; the texts are read once, and nothing is shuffled
but the counts.

Defined results: null or empty text has no spans; repeated rows are judged row by row; an empty table gives an empty
result; without any candidates the classifier is the prior and adds nothing; columns other than id and text are not
read. Patterns use possessive loops and start only where a run starts, so that they are linear in the text.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let, lets, table

# The base kinds. \G lets a match start where the last one ended, as the plain patterns would.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"not exists(split(s, '\\.'), q -> not q rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "length(s) >= 16 and length(d) between 16 and 19 and " + "{luhn}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(s, '[^0-9]+', '')) between 8 and 15"),
}
#: Needed for any match; a cheap test before the pattern.
NEEDS = {"email": "contains(text, '@')", "ip": "digits", "card": "digits", "phone": "contains(text, '+')"}

# The words that assign a secret.
SECRET_CUES = "(?i:token|key|secret|password|passwd|pwd|auth|bearer)"

# The wider candidates, first alternative first: what must stand before, the span, what must stand after.
WIDER = {
    "account": (r"(?<![A-Za-z0-9])", r"[0-9](?:[\x20-]?[0-9]){11,18}", r"(?![A-Za-z0-9])"),
    "ssn": (r"(?<![A-Za-z0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?![A-Za-z0-9-])"),
    "national_phone": (r"(?<![A-Za-z0-9])", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"(?![A-Za-z0-9])"),
    "iban": (r"(?<![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}", r"(?![A-Za-z0-9])"),
    "secret": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])", r"[A-Za-z0-9+/_-]{20,}+={0,2}", ""),
    "disguised_email": (r"(?<![A-Za-z0-9._%+-])", r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,64}+(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]{1,64}+)+", ""),
    # any value in quotes, or one with a digit after an equals sign, that a cue word assigns
    "assigned": (rf"(?<=[\"'=]|=\x20)(?<={SECRET_CUES}\x20{{0,2}}[=:]\x20{{0,2}}[\"']?)(?:(?<=[\"'])(?=[^\s\"'<>\[\]]{{4,}}+[\"'])|(?<![\"'])(?=[A-Za-z_]*+[0-9]))", r"[^\s\"'<>,;\[\]]{4,}+", ""),
}
KINDS = [*BASE, *WIDER]

# Cue words that announce personal data or secrets.
CUES = "token key secret password passwd pwd auth bearer api account acct iban bic card visa mastercard ssn social security tel telephone phone mobile cell fax call contact mail email e-mail".split()

#: Takes the spaces and hyphens out of s.
STRIP = "regexp_replace(s, '[ -]+', '')"
LUHN = "aggregate(transform(split(reverse(d), ''), (c, i) -> cast(c as int) * (1 + i % 2) - if(i % 2 = 1 and cast(c as int) > 4, 9, 0)), 0, (a, x) -> a + x) % 10 = 0"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Arrays are folded in runs of so many elements: appending one by one would copy a long array again and again.
RUN = 256


def found_sql(text: str, pattern: str, context: int = 0) -> str:
    """Array of (start, end, s, and before and after of `context` code points) of the pattern's matches.

    The text between the matches has the rest of the positions: split() and regexp_extract_all() walk alike.
    """
    more = f", right(g[i], {context}) as before, left(g[i + 1], {context}) as after" if context else ""
    kind = "array<struct<start:bigint,end:bigint,s:string" + (",before:string,after:string" if context else "") + ">>"
    one = "struct(a.p + length(g[i]) as start, a.p + length(g[i]) + length(m[i]) as end, m[i] as s" + more + ")"
    run = f"aggregate(sequence(c * {RUN}, least(size(m), (c + 1) * {RUN}) - 1), struct(offsets[c] as p, cast(array() as {kind}) as o), (a, i) -> struct(a.p + length(g[i]) + length(m[i]) as p, concat(a.o, array({one})) as o), a -> a.o)"
    return lets(
        f"if(size(m) = 0, cast(array() as {kind}), " + lets(
            f"flatten(transform(runs, c -> {run}))",
            ("runs", f"sequence(0, cast(ceil(size(m) / {RUN}) as int) - 1)"),
            ("offsets", f"aggregate(transform(runs, c -> aggregate(sequence(c * {RUN}, least(size(m), (c + 1) * {RUN}) - 1), 0L, (a, i) -> a + length(g[i]) + length(m[i]))), struct(0L as p, cast(array() as array<bigint>) as o), (a, x) -> struct(a.p + x as p, concat(a.o, array(a.p)) as o), a -> a.o)"),
        ) + ")",
        ("m", f"regexp_extract_all({text}, {quoted(pattern)}, 0)"),
        ("g", f"if(size(m) = 0, array(), split({text}, {quoted(pattern)}, -1))"),
    )


def base_sql(kind: str) -> str:
    pattern, check = BASE[kind]
    check = check.format(luhn=LUHN) if "{luhn}" in check else check
    keep = f"filter({found_sql('text', pattern)}, x -> {lets(check, ('s', 'x.s'), ('d', STRIP))})"
    return f"if({NEEDS[kind]}, transform({keep}, x -> struct(x.start as start, x.end as end)), cast(array() as array<struct<start:bigint,end:bigint>>))"


def voted_sql() -> str:
    """Array of the wider candidates of a text with their kind, votes and features."""
    any_of = "|".join(f"(?:{''.join(p)})" for p in WIDER.values())
    kind = "case " + " ".join(f"when c.s rlike {quoted(f'^(?:{p})$')} then '{k}'" for k, (_, p, _) in WIDER.items()) + " end"
    digits = "length(regexp_replace(c.s, '[^0-9]+', ''))"
    checksum = f"if(length(c.s) between 12 and 40 and {digits} between 12 and 19 and c.s rlike '^[0-9 -]+$', if({lets(LUHN, ('s', 'c.s'), ('d', STRIP))}, 1, 0), 0)"
    distinct = "size(array_distinct(split(c.s, '')))"
    votes = {
        "shape": "if(c.s rlike '^[0-9a-fA-F]{32,}$' or c.s rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' or c.s rlike '^\\\\(?[0-9]{3}\\\\)?[ .-][0-9]{3}[ .-][0-9]{4}$' or c.s rlike '\\\\((at|dot)\\\\)|\\\\[(at|dot)\\\\]' or c.s rlike '^[0-9]{16}$', 1, 0)",
        "checksum": checksum,
        "cue": f"if(lower(c.before) rlike '(?<![a-z])(?:{'|'.join(CUES)})[^a-z]{{0,8}}$', 1, 0)",
        "assigned": r"if(c.before rlike '[=:]\\s*[\"\']?$' or (c.before rlike '[\"\']$' and c.after rlike '^[\"\']'), 1, 0)",
        "variety": f"case when {distinct} >= 8 then 1 when {distinct} <= 3 then -1 else 0 end",
        "counter": r"if(c.before rlike '[$€£#]\\s*$' or c.after rlike '^\\s*(?:%|km|kg|pages?\\b|years?\\b)' or c.after rlike '^[.,][0-9]', -1, 0)",
    }
    length = "case when length(c.s) < 12 then 'a' when length(c.s) < 16 then 'b' when length(c.s) < 20 then 'c' when length(c.s) < 32 then 'd' when length(c.s) <= 48 then 'e' else 'f' end"
    share = f"case when {digits} = length(c.s) then 'all' when 2 * {digits} >= length(c.s) then 'most' when {digits} > 0 then 'some' else 'none' end"
    side = "case when {0} = '' then 'edge' when {0} rlike '{1}' then 'space' when {0} rlike '{2}' then 'quote' else 'other' end"
    fields = ", ".join(f"cast({v} as int) as {k}" for k, v in votes.items())
    sides = side.format("c.before", r"\\s$", "[\"\\'`(]$") + " as before, " + side.format("c.after", r"^[\\s.,;]", "^[\"\\'`)]") + " as after"
    return f"transform({found_sql('text', any_of, 32)}, c -> struct(c.start as start, c.end as end, {kind} as kind, {fields}, {length} as length, {share} as digits, {sides}))"


VOTES = ("shape", "checksum", "cue", "assigned", "variety", "counter")
FEATURES = ("kind", "length", "digits", "before", "after")


def reliabilities(patterns: list[tuple], rounds: int = 60) -> tuple[dict, dict, list[float]]:
    """Expectation-maximisation for a mixture of two classes with votes independent given the class.

    patterns: (kind, votes, count). Returns P(true | kind), P(vote v of labeler l | class) and each pattern's posterior.
    It starts from the votes' sum, and pseudo-counts favour labelers that are right more often than not.
    """
    post = [1 / (1 + math.exp(-(1.5 * sum(v) - 1.5))) for _, v, _ in patterns]
    rate: dict = {}
    vote: dict = {}
    for _ in range(rounds):
        mass, true = defaultdict(float), defaultdict(float)
        vote = defaultdict(float)
        for l in range(len(VOTES)):
            for y in (0, 1):
                for v in (-1, 0, 1):
                    vote[l, y, v] = 4.0 if v == 0 else (2.0 if (v > 0) == bool(y) else 0.25)
        for (kind, votes, n), p in zip(patterns, post):
            mass[kind] += n
            true[kind] += n * p
            for l, v in enumerate(votes):
                vote[l, 1, v] += n * p
                vote[l, 0, v] += n * (1 - p)
        rate = {k: (true[k] + 1) / (mass[k] + 2) for k in mass}
        for l in range(len(VOTES)):
            for y in (0, 1):
                total = sum(vote[l, y, v] for v in (-1, 0, 1))
                for v in (-1, 0, 1):
                    vote[l, y, v] /= total
        post = []
        for kind, votes, _ in patterns:
            log = math.log(rate[kind] / (1 - rate[kind])) + sum(math.log(vote[l, 1, v] / vote[l, 0, v]) for l, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-max(-40.0, min(40.0, log)))))
    return rate, dict(vote), post


def classifier(counts: list[tuple], smooth: float = 1.0) -> tuple[float, dict]:
    """Naive Bayes from soft labels: (log odds of the prior, log odds of each (name, value)). counts: (values by
    name, posterior, count)."""
    mass = [smooth, smooth]
    seen: dict = defaultdict(lambda: [0.0, 0.0])
    for values, p, n in counts:
        for y, w in ((1, n * p), (0, n * (1 - p))):
            mass[y] += w
            for key in values.items():
                seen[key][y] += w
    sizes = defaultdict(int)
    for name, _ in seen:
        sizes[name] += 1
    odds = {k: math.log((a[1] + smooth) / (mass[1] + smooth * sizes[k[0]])) - math.log((a[0] + smooth) / (mass[0] + smooth * sizes[k[0]])) for k, a in seen.items()}
    return math.log(mass[1] / mass[0]), odds


FOUND = (*BASE, "candidates")


#: Parts of the search, each over the columns or variables that the ones before it name.
DIGITS = "{0} rlike '[0-9]'"
EMPTY = "cast(array() as array<struct<start:bigint,end:bigint,kind:string," + "".join(f"{v}:int," for v in VOTES) + "length:string,digits:string,before:string,after:string>>)"
BASE_SPANS = "array_sort(concat(" + ", ".join(BASE) + "))"
_PART = f"slice(base, k * {RUN} + 1, {RUN})"
_PARTS = f"transform(sequence(0, cast(ceil(size(base) / {RUN}) as int) - 1), k -> struct({_PART} as part, array_min({_PART}).start as low, array_max(transform({_PART}, b -> b.end)) as high))"
#: The candidates that overlap no base span.
FREE = "if(size(candidates) = 0 or size(base) = 0, candidates, " + let(_PARTS, "parts", "filter(candidates, c -> not exists(parts, k -> c.start < k.high and k.low < c.end and exists(k.part, b -> c.start < b.end and b.start < c.end)))") + ")"


def candidates_sql() -> str:
    return f"if(digits or text rlike {quoted(r'[(\[]at[)\]]|' + SECRET_CUES + r'\x20{0,2}[=:]')}, {voted_sql()}, {EMPTY})"


def located(docs: DataFrame, text: str, *columns: str) -> DataFrame:
    """The columns named, the base kinds' spans and the wider candidates that overlap none of them."""
    d = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    d = d.select(*columns, F.col("__text").alias("text"), F.expr(DIGITS.format("__text")).alias("digits"))
    d = d.select(*columns, *(F.expr(base_sql(k)).alias(k) for k in BASE), F.expr(candidates_sql()).alias("candidates"))
    d = d.select(*columns, *FOUND, F.expr(BASE_SPANS).alias("base"))
    return d.select(*columns, *BASE, F.expr(FREE).alias("candidates"))


def learned(found: DataFrame) -> str:
    """SQL of the classifier's spans, an array of (kind, start, end, probability), from the candidates of found."""
    seen = found.select(F.explode("candidates").alias("c")).select("c.*").groupBy(*FEATURES, *VOTES).agg(F.count("*").alias("n")).collect()
    by: dict = defaultdict(int)
    for r in seen:
        by[r["kind"], tuple(r[v] for v in VOTES)] += r["n"]
    patterns = sorted((k, v, n) for (k, v), n in by.items())
    post = reliabilities(patterns)[2] if patterns else []
    of = {(k, v): p for (k, v, _), p in zip(patterns, post)}
    names = (*FEATURES, *VOTES)
    prior, odds = classifier([({x: r[x] for x in names}, of[r["kind"], tuple(r[v] for v in VOTES)], r["n"]) for r in sorted(seen, key=str)])
    terms = [repr(prior) + "D"]
    for name in names:
        values = sorted((str(v), o) for (k, v), o in odds.items() if k == name)
        if values:
            terms.append(f"case cast(c.{name} as string) " + " ".join(f"when '{v}' then {o!r}D" for v, o in values) + " else 0D end")
    logit = " + ".join(terms)
    return f"filter(transform(candidates, c -> struct(c.kind as kind, c.start as start, c.end as end, 1 / (1 + exp(-({logit}))) as probability)), c -> c.probability >= 0.5)"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, the base kinds' spans (arrays of (start, end)) as email, ip, card, phone, and added: array of
    (kind, start, end, probability) of the classifier's spans."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = Scratch(docs.sparkSession, "pii").keep(located(d, "text", "doc_id"), "found")
    return found.select("doc_id", *BASE, F.expr(learned(found)).alias("added"))


def ordered_sql(base: str = "") -> str:
    """Array of (start, -end, kind) of the base kinds' spans, which stand under their names after `base`, and of added,
    in order."""
    each = [f"transform({base}{k}, x -> struct(x.start as start, -x.end as e, '{k}' as kind))" for k in BASE]
    return "array_sort(concat(" + ", ".join(each) + ", transform(added, x -> struct(x.start as start, -x.end as e, x.kind as kind))))"


def spans_sql(text: str, added: str) -> str:
    """The ordered spans of a text, base and added, in one expression."""
    kinds = ", ".join(f"{base_sql(k)} as {k}" for k in BASE)
    return lets(
        ordered_sql("f."),
        ("text", text), ("digits", DIGITS.format("text")), ("f", f"struct({kinds}, {candidates_sql()} as candidates)"),
        ("base", "array_sort(concat(" + ", ".join(f"f.{k}" for k in BASE) + "))"), ("candidates", "f.candidates"), ("candidates", FREE), ("added", added))


def replaced_sql(raw: str, spans: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stands, the longer of
    two with one start. Pieces are joined in runs, so that a text of many spans is not copied for each."""
    piece = f"array(substring({raw}, cast(a.p + 1 as int), cast(x.start - a.p as int)), concat('[', x.kind, ']'))"
    flush = f"if(size(a.o) < {RUN}, struct(-x.e as p, concat(a.o, {piece}) as o, a.r as r), struct(-x.e as p, {piece} as o, concat(a.r, array(array_join(a.o, ''))) as r))"
    none = "cast(array() as array<string>)"
    return f"aggregate({spans}, struct(0L as p, {none} as o, {none} as r), (a, x) -> if(x.start < a.p, a, {flush}), a -> concat(array_join(a.r, ''), array_join(a.o, ''), substring({raw}, cast(a.p + 1 as int))))"


def settled_sql(text: str, added: str) -> str:
    """The text with its spans replaced, again and again until none is left. What replaces a span is no part of any
    other, and each span has a digit, an @, an (at) or an assignment before it, so these bound the turns."""
    turn = let(spans_sql("b.t", added), "spans", f"if(size(spans) = 0, struct(b.t as t, true as done), struct({replaced_sql('b.t', 'spans')} as t, false as done))")
    return f"aggregate(sequence(1, greatest(1, regexp_count({text}, '[0-9@=:]|[(\\\\[]at[)\\\\]]'))), struct({text} as t, false as done), (b, turn) -> if(b.done, b, {turn}), b -> b.t)"


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows and columns of docs, each span of a text replaced by its kind in brackets, until no text has a span: what
    a span leaves behind can be one of its own. Null texts stay null. No shuffle: the classifier is learned in a first
    pass over the texts and applied in a second. Its spans are the first turn's; only texts that have some are read
    again, until they have none."""
    d = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("__raw"))
    scratch = Scratch(docs.sparkSession, "redact")
    added = learned(scratch.keep(located(d, "__raw").where("size(candidates) > 0"), "found"))
    scratch.drop()
    f = located(d, "__raw", "__row", "__raw").select("__row", "__raw", *BASE, F.expr(added).alias("added"))
    f = f.select("__row", "__raw", F.expr(ordered_sql()).alias("spans"))
    f = f.select("__row", "__raw", F.expr(f"if(__raw is not null and size(spans) > 0, {replaced_sql('__raw', 'spans')}, null)").alias("__once"))
    f = f.select("__row", F.expr(f"if(__once is null, __raw, {settled_sql('__once', added)})").alias("__raw"))
    return f.select(*(F.col("__raw").alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from the spans of find(); n_added counts those that are of no base kind."""
    each = ", ".join(f"transform(array_sort({k}), x -> concat('{k}:', x.start, ':', x.end))" for k in BASE)
    rank = "transform(added, x -> struct(" + "array_position(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.kind) as k, x.start as start, x.end as end, x.kind as kind))"
    more = f"transform(array_sort({rank}), x -> concat(x.kind, ':', x.start, ':', x.end))"
    out = found.select("doc_id", *(F.expr(f"cast(size({k}) as bigint)").alias(f"n_{k}") for k in BASE), F.expr(f"concat({each})").alias("base"), F.expr(more).alias("more"))
    return out.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join(F.concat("base", "more"), ",").alias("spans"), F.size("more").cast("bigint").alias("n_added"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents")))
