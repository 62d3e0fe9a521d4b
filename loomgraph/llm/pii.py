"""Personal data: regular expressions propose spans, checksums confirm them, nearby words move the score.

Everything is a Spark column expression. A span's place comes from splitting the text at the matches: the n-th
match starts after the n first pieces and the matches between them, all counted in code points by one running fold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """How one kind of personal data is found."""

    name: str
    pattern: str  #: leftmost, non-overlapping; possessive where that can't change a match, so no text is scanned twice
    needs: str  #: a cheap pattern that every text with a match holds
    base: float  #: score of a confirmed match without context
    context: tuple[str, ...] = ()  #: lower-case words that raise the score if they stand just before
    always: bool = False  #: kept whatever the score


#: The four base kinds in the order in which they are listed, then those that need confirmation by checksum or context.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", 0.9, ("mail", "email", "contact"), True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.6, ("ip", "host", "server", "address"), True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", r"[0-9](?:[\x20-]?[0-9]){12}", 0.8, ("card", "visa", "credit", "payment"), True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, ("phone", "tel", "call", "mobile", "fax"), True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.9, ("iban", "account", "bank", "konto", "cuenta", "compte")),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.3, ("ssn", "social", "security", "insurance")),
)
#: A proposal that isn't always kept needs this score.
LEAST = 0.5
#: What a context word adds, and how many characters before the span are looked at.
BONUS, WINDOW = 0.3, 40

#: Items of an array that one inner fold takes: appending to an array copies it, so folds work on short ones.
RUN = 64
#: Code points of the blocks from which pieces of a text are cut.
BLOCK = 1024


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda's variable, where an expression would be computed for each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items: Column, state: dict[str, Column], step, emit, out: str) -> Column:
    """What ``emit`` makes of each item and the state before it, as an array<``out``>; ``step`` gives the next state.

    A running fold in near-linear time: folds copy what they carry, so a first pass over runs of ``RUN`` items carries
    the state alone and notes it at each run's start, and a second one carries no more than one run's results.
    """
    pack = lambda fields: F.struct(*[c.alias(k) for k, c in fields.items()])
    of = lambda acc: {k: acc[k] for k in state}
    after = lambda acc, x: pack(step(of(acc), x))

    def note(acc: Column, run: Column) -> Column:
        return let(F.aggregate(run, acc["now"], after), lambda now: pack({"now": now, "starts": F.concat(acc["starts"], F.array(acc["now"]))}))

    def one(z: Column) -> Column:
        grow = lambda acc, x: pack({"now": after(acc["now"], x), "got": F.concat(acc["got"], F.array(emit(of(acc["now"]), x)))})
        return F.aggregate(z["run"], pack({"now": z["start"], "got": F.array().cast(f"array<{out}>")}), grow, lambda acc: acc["got"])

    def fold(runs: Column) -> Column:
        first = F.slice(F.array(pack(state)), 1, 0)
        starts = F.aggregate(runs, pack({"now": pack(state), "starts": first}), note, lambda acc: acc["starts"])
        return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), starts.alias("start")), one))

    def cut(all_: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda i: F.slice(all_, i * RUN + 1, RUN))
        return F.when(F.size(all_) > 0, let(runs, fold)).otherwise(F.array().cast(f"array<{out}>"))

    return let(items, cut)


def _placed(text: Column, pattern: str) -> Column:
    """All matches as an array of (start, end, text, before), offsets in code points, end exclusive; ``before`` is the text just before the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("p"), found.alias("m"))

    def step(s: dict[str, Column], x: Column) -> dict[str, Column]:
        return {"at": s["at"] + F.char_length(x["p"]) + F.char_length(x["m"]), "tail": _right(F.concat(s["tail"], _right(x["p"]), _right(x["m"])))}

    def emit(s: dict[str, Column], x: Column) -> Column:
        start = s["at"] + F.char_length(x["p"])
        return F.struct(start.alias("start"), (start + F.char_length(x["m"])).alias("end"), x["m"].alias("text"), _right(F.concat(s["tail"], _right(x["p"]))).alias("before"))

    return scan(pairs, {"at": F.lit(0), "tail": F.lit("")}, step, emit, "struct<start:int,end:int,text:string,before:string>")


def _right(s: Column) -> Column:
    """The last ``WINDOW`` code points."""
    return F.right(s, F.lit(WINDOW))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check (Spark's own, which is null for no digits)."""
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def mod97(code: Column) -> Column:
    """Whether an IBAN-like code passes the mod-97 check: the first four characters go last, letters count 10 to 35."""
    moved = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        v = F.ascii(ch)
        return F.when(v <= 57, (acc * 10 + v - 48) % 97).otherwise((acc * 100 + v - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda ch: ch != ""), F.lit(0), step) == 1


def confirmed(kind: str, s: Column) -> Column:
    """The validator of each kind over the matched text."""
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("decimal(38,0)"), F.lit(256)) <= 255)
    if kind == "card":
        d = _digits(s)
        return F.char_length(d).between(13, 19) & luhn(d)
    if kind == "phone":
        return F.char_length(_digits(s)).between(9, 15)
    if kind == "iban":
        code = F.replace(s, F.lit(" "), F.lit(""))
        return F.char_length(code).between(15, 34) & mod97(code)
    if kind == "ssn":
        return ~s.rlike("^(?:000|666|9..)") & ~s.rlike("-00-") & ~s.rlike("0000$")
    return F.lit(True)


def _spans(text: Column, k: Kind) -> Column:
    """Confirmed spans of one kind with their scores; null where the text can't hold one."""
    near = "(?<![a-z])(?:" + "|".join(k.context) + ")(?![a-z])"

    def scored(x: Column) -> Column:
        score = F.least(F.lit(1.0), F.lit(k.base) + F.when(F.lower(x["before"]).rlike(near), BONUS).otherwise(0.0))
        return F.struct(F.lit(k.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), score.alias("score"))

    spans = F.transform(F.filter(_placed(text, k.pattern), lambda x: confirmed(k.name, x["text"])), scored)
    if not k.always:
        spans = F.filter(spans, lambda x: x["score"] >= LEAST)
    return F.when(text.rlike(k.needs), spans)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pii``: an array of (kind, start, end, text, score) over the whole text, kinds in the order of ``KINDS``, then by start.

    Base kinds (email, ip, card, phone) are always kept once valid; iban (mod-97) and ssn (context words) are
    added if their score reaches ``LEAST``. Null and empty texts give an empty array. Row order, repeated rows
    and other columns pass through; a column ``pii`` in the input is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,text:string,score:double>>")
    return docs.withColumn("pii", F.concat(*[F.coalesce(_spans(body, k), none) for k in KINDS]))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every found span by ``[KIND]``; overlapping spans go as one, by the kind of the one that starts first (then the longer).

    Needs the column ``pii`` of :func:`find_pii`. Texts without spans, null and empty ones included, stay as they are.
    """
    body = F.col(text)
    order = F.array_sort(F.transform("pii", lambda x: F.struct(x["start"], (-x["end"]).alias("n"), x["kind"])))
    # (from, to, kind): a span that starts no union of its own only widens the one before
    reach = scan(
        order, {"at": F.lit(0)}, lambda s, x: {"at": F.greatest(s["at"], -x["n"])},
        lambda s, x: F.struct(s["at"].alias("from"), x["start"].alias("to"), x["kind"].alias("kind")), "struct<from:int,to:int,kind:string>",
    )
    heads = F.filter(reach, lambda x: (x["to"] >= x["from"]))
    end = F.array_max(F.transform("pii", lambda x: x["end"]))

    def rebuilt(blocks: Column) -> Column:
        pieces = F.transform(heads, lambda x: F.concat(_cut(blocks, x["from"], x["to"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.array_join(pieces, ""), _cut(blocks, end, F.char_length(body)))

    done = let(F.regexp_extract_all(body, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)), rebuilt)
    return docs.withColumn(text, F.when(F.size("pii") > 0, done).otherwise(body))


def _cut(blocks: Column, a: Column, b: Column) -> Column:
    """Code points ``a`` to ``b`` (exclusive) of the text whose blocks of ``BLOCK`` code points these are."""
    first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
    one = F.substring(F.get(blocks, first), a % BLOCK + 1, b - a)
    more = F.concat(F.substring(F.get(blocks, first), a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.get(blocks, last), F.lit(1), (b - 1) % BLOCK + 1))
    return F.when(b <= a, "").when(first == last, one).otherwise(more)


def digest(found: DataFrame) -> DataFrame:
    """Counts and span strings of the result of :func:`find_pii`, one row per document."""
    base = [k.name for k in KINDS if k.always]
    as_text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda n: F.size(F.filter("pii", lambda x: x["kind"] == n)).cast("long").alias(f"n_{n}")
    counts = [count(n) for n in base]
    return found.select(
        "doc_id", *counts, F.sha2(as_text(F.filter("pii", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), as_text(F.col("pii")).alias("spans"), F.array_max(F.transform("pii", lambda x: x["score"])).alias("top_score")
    )
