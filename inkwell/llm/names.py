"""Variant spellings of the names of persons and organisations, linked to one entity.

Distinct spellings are reduced to tokens (titles, legal forms and marks removed, look-alike
letters and accents folded, short forms written out); spellings with the same tokens make a
class. A symmetric-delete neighbourhood index over the tokens finds the classes that share a
telling token within one edit; `aligned` then verifies a pair by an optimal assignment of all
tokens, permitting initials, nicknames and abbreviations. A class is linked to the weightiest
class that it is aligned with, links are followed to their roots, and mentions of one root are
one entity.

The neighbourhoods are found among the distinct tokens; names then meet by whole tokens. Every
full token of a name is indexed, each together with the first letters of the name's other
tokens; those that are about as rare as its rarest are telling and look up the tokens of all
other names. So neither common given names nor common words bring classes together, while
`E. Moll` meets `Emil Moll` however frequent Moll is. Names whose telling tokens are all
initials in the other name don't meet (Ioana H. Moll and Ioana M. Haber are two people). All
steps are equi-joins on distinct classes; mentions join in only at the end.

Defined results: null and blank names are linked to none; equal spellings are always linked,
whatever their field; a person's name of one token is linked to equal tokens only; repeated
rows are linked to each other; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from math import lgamma, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.addresses import _close, _deleted, near
from inkwell.llm.confusables import _compatibility, _look_alikes
from inkwell.session import cut

# Short forms of given names.
NICKNAMES = {
    "robert": "rob bob bobby robbie", "gabriela": "gabi gaby", "katharina": "kati kathi katja kat", "francisco": "fran paco pancho", "guadalupe": "lupe lupita",
    "dorothea": "doro thea dora", "theresa": "tess terry tessa resi", "dmitri": "dima mitya", "veronica": "vera ronnie roni", "frederic": "fred freddy",
    "benedikt": "ben bene", "ioana": "oana", "william": "bill will billy", "elizabeth": "liz beth lisa betty", "alexander": "alex sascha sasha", "maximilian": "max",
    "margaret": "maggie meg peggy", "sebastian": "basti seb", "johannes": "hannes johann", "nathaniel": "nate nat", "tadeusz": "tadek", "yevgeny": "zhenya",
    "michael": "mike michi mick", "thomas": "tom tommy", "james": "jim jimmy", "joseph": "joe joey", "richard": "rick dick rich", "charles": "charlie chuck",
    "edward": "ed eddie ted", "andreas": "andi", "matthias": "matze", "christian": "chris", "daniel": "dan danny", "david": "dave", "anthony": "tony", "samuel": "sam",
    "mehmet": "memo", "ingrid": "inga",
}

# Words of organisations and their short forms (folded).
ORG_WORDS = {
    "instruments": "instr instrument", "optics": "opt", "industries": "ind industry", "international": "intl", "manufacturing": "mfg manuf", "systems": "sys system",
    "technologies": "tech technology", "robotics": "rob", "electronics": "electr", "pharmaceuticals": "pharma pharm", "laboratories": "lab labs laboratory",
    "university": "univ universitat universite universidad", "chemicals": "chem", "engineering": "eng", "institute": "inst", "research": "res", "group": "grp",
    "holding": "holdings", "services": "svc", "solutions": "",
}

# Words of legal forms and of attorneys' firms that name nobody (folded).
ORG_NOISE = set(
    "the of and und et y u a an fur for inc incorporated ltd limited llc llp lp plc corp corporation co company gmbh mbh ag kg ohg gesellschaft mit beschrankter haftung "
    "aktiengesellschaft sa societe anonyme sas sarl spa srl bv nv oy osakeyhtio ab as asa aps a s liability partnership partg "
    "patent patentanwalte patentanwaelte patentanw patanw anw anwalte attorneys attorney attys att pat ip pi cpi mbb conseils conseil en propriete industrielle".split()
)
ORG_SIGNS = set(
    "inc incorporated ltd limited llc llp plc corp corporation company gmbh mbh ag kg gesellschaft haftung aktiengesellschaft sa societe anonyme sas sarl spa srl bv nv oy "
    "osakeyhtio aps liability partnership partg patentanwalte patentanwaelte patentanw patanw attorneys attys conseils cpi & the".split()
)
# Marks of persons that name nobody (folded).
PERSON_NOISE = set("prof dr dipl ing mr mrs ms miss herr herrn frau mme mlle phd md msc mba dring dipling deceased verstorben decede et al jr sr sir lady und".split())

COMMON = 20  # times a token's count that a frequent neighbour must have to take it over
RARE = 4.0  # a token is telling if it is at most this many times as frequent as the rarest of its name
TYPING = 0.15  # share of the mentions of a name that may be spelt with a given typing error
ODDS = 0.2  # likelihood of one mistyped name against that of two names from which they are one


@cache
def _looks() -> dict[int, str]:
    single, several = _compatibility()
    return str.maketrans({**single, **several, **_look_alikes()})


def folded(text: str) -> str:
    """Lower case without accents, look-alikes and invisible characters; ß as ss; one kind of
    hyphen."""
    text = unicodedata.normalize("NFC", "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc") or c in "\t\n"))
    text = unicodedata.normalize("NFKD", text.translate(_looks()).replace("ß", "ss"))
    return re.sub("[‐‑‒–−]", "-", "".join(c for c in text if not unicodedata.combining(c)).lower())


_ORG_OF = {folded(w): k for k, words in ORG_WORDS.items() for w in [k, *words.split()]}
_ORG_CANON = {k: folded(k) for k in ORG_WORDS}
_NICK_OF = {folded(w): folded(k) for k, words in NICKNAMES.items() for w in words.split()}
_NOISE = {folded(w) for w in ORG_NOISE}
_SIGNS = {folded(w) for w in ORG_SIGNS}
_PERSON = {folded(w) for w in PERSON_NOISE}


def raw_tokens(name: str) -> list[str]:
    """Folded tokens in order. A final dot marks an abbreviation (`instr.`) or an initial
    (`r.`); dotted letters are joined (`s.p.a.` gives `spa`, `a.-m.` gives `am.`); `,` stays."""
    text = re.sub(r"\(([^)]*)\)", r" \1 ", folded(name)).replace("int'l", "intl").replace("int’l", "intl")
    text = re.sub(r"\s*[&+/]\s*", " & ", text).replace(",", " , ")
    out = []
    for chunk in text.split():
        chunk = chunk.strip("'\"’`;:-")
        if chunk in (",", "&"):
            out.append(chunk)
        elif re.fullmatch(r"(?:[^\W\d_]\.-?){2,}[^\W\d_]?\.?", chunk):
            letters = re.sub(r"[.-]", "", chunk)
            out.append(letters + ("." if "-" in chunk or len(letters) == 2 and letters not in _NOISE else ""))
        elif re.fullmatch(r"[^\W_]+(?:[.'’-][^\W_]+)+\.?", chunk):
            parts = [p for p in re.split(r"[.'’-]", chunk.rstrip(".")) if p]
            joined = "".join(parts)
            if joined in ("phd", "drin", "dring", "dipling", "patanw"):
                out.append(joined)
            elif "-" in chunk and any(p in _ORG_OF or p in _NOISE and len(p) > 1 or _fuzzy_org(p) for p in parts[1:]):
                out += parts[:-1] + [parts[-1] + ("." if chunk.endswith(".") else "")]
            elif "." in chunk and any(p in _PERSON for p in parts):
                out += parts
            else:
                out.append(joined)
        else:
            word = re.sub(r"[^\w.]", "", chunk)
            if word.strip("."):
                out.append(word.replace(".", "") + ("." if word.endswith(".") else ""))
    return out


def _fuzzy_org(word: str) -> str | None:
    if len(word) >= 6:
        for w in _ORG_CANON.values():
            if near(word, w):
                return w
    return None


def classified(tokens: list[str], kind: str) -> tuple[str, list[str]]:
    """(`P` or `O`, canonical tokens). kind: `P`, `O`, or `?` where the tokens must tell."""
    bare = [t.rstrip(".") for t in tokens]
    if kind == "?":
        sign = any(b in _SIGNS and len(b) > 1 or t == "&" for t, b in zip(tokens, bare) if t not in ("a.", "s."))
        word = any(b in _ORG_OF and (b in _ORG_CANON.values() or t.endswith(".") or len(b) > 3 and b not in _NICK_OF) or _fuzzy_org(b) for t, b in zip(tokens, bare))
        kind = "O" if sign or word else "P"
    if kind == "O":
        out = []
        for b in bare:
            if b in (",", "&", "") or b in _NOISE or len(b) == 1:
                continue
            k = _ORG_OF.get(b)
            out.append(_ORG_CANON[k] if k else _fuzzy_org(b) or b)
        return "O", out or [b for b in bare if b not in (",", "&")]
    out, comma = [], 0
    for t, b in zip(tokens, bare):
        if t == ",":
            comma = comma or len(out)
        elif b and t != "&" and (b not in _PERSON or len(b) == 1):
            out.append(b + "." if len(b) == 1 or t.endswith(".") and len(b) == 2 else _NICK_OF.get(b, b))
    return "P", out or [b for b in bare if b not in (",", "&")]


_UMLAUT = re.compile(r"([aou])e")


def aligned(a: list[str], b: list[str], counts: dict[str, int], forms: dict[str, int] | None = None) -> bool:
    """Whether an optimal assignment of the tokens of two names leaves no full token over and
    needs at most one edit for a token, two in all. Initials stand for tokens that begin with
    them and may stay over, as middle initials do; at least one full token must be met. An edit
    that the mentions (`counts`) leave in doubt is decided by the spellings of the names that
    hold the token (`forms`), if another full token is equal."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    never = 1e6
    spare = [[0.0 if t.endswith(".") else never for t in long] for _ in range(len(long) - len(short))]
    for exact in (False, True) if forms else (False,):
        costs = [[_match(s, t, counts, forms if exact else None) for t in long] for s in short]
        rows = [[never if c is None else c for c in row] for row in costs]
        if sum(min(row, default=0) for row in rows) > 2 or _cheapest(rows + spare) > 2:
            continue
        pairs = [(c, i, j) for i, row in enumerate(rows) for j, c in enumerate(row) if c <= 2 and not short[i].endswith(".") and not long[j].endswith(".")]
        for c, i, j in sorted(pairs):
            if (not exact or short[i] == long[j]) and _cheapest([[x if k == j else never for k, x in enumerate(row)] if r == i else row for r, row in enumerate(rows)] + spare) <= 2:
                return True
    return False


def _cheapest(costs: list[list[float]]) -> float:
    """The cost of the cheapest assignment of a square matrix (Hungarian method)."""
    n = len(costs)
    u, v, held = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        held[0], j, least, back, used = i, 0, [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while held[j]:
            used[j], row, step, after = True, held[j], float("inf"), 0
            for k in range(1, n + 1):
                if not used[k]:
                    c = costs[row - 1][k - 1] - u[row] - v[k]
                    if c < least[k]:
                        least[k], back[k] = c, j
                    if least[k] < step:
                        step, after = least[k], k
            for k in range(n + 1):
                if used[k]:
                    u[held[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = after
        while j:
            held[j] = held[back[j]]
            j = back[j]
    return sum(costs[held[k] - 1][k - 1] for k in range(1, n + 1))


def misspelt(less: int, more: int, odds: float = ODDS) -> bool:
    """Whether `less` mentions beside `more` read as typing errors of one name: the likelihood
    of that split if each mention is mistyped with probability TYPING, against that of two
    names of any two frequencies. No count is large or small by itself: a share of errors below
    TYPING is one name at any size, and the more mentions there are, the less a larger share
    passes for chance."""
    n = less + more
    if less <= TYPING * n:
        return True
    one = lgamma(n + 1) - lgamma(less + 1) - lgamma(more + 1) + less * log(TYPING) + more * log(1 - TYPING)
    return one + log(n + 1) >= log(odds)


def _match(s: str, t: str, counts: dict[str, int], forms: dict[str, int] | None) -> float | None:
    """The cost of taking `s` and `t` for one token, None if they are two. What the mentions
    deny, the distinct spellings may still show, if they speak for one name and not just
    don't speak against it."""
    if s == t:
        return 0.0
    if s.endswith(".") or t.endswith("."):
        x, y = (s, t) if s.endswith(".") else (t, s)
        return 0.25 if y.startswith(x[0]) else None
    plain_s, plain_t = (_UMLAUT.sub(r"\1", x) for x in (s, t))  # ö is written as o or oe
    if plain_s == plain_t:
        return 0.25
    if len(s) >= 4 and len(t) >= 4 and (near(s, t) or near(plain_s, plain_t)):
        # Two spellings that are both well attested are two names.
        split = lambda n: sorted((n.get(s, 0), n.get(t, 0)))
        if misspelt(*split(counts)) or forms and misspelt(*split(forms), odds=1.0):
            return 1.0
    return None


def _spelling_tokens(names: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = pa.array([raw_tokens(n) for n in batch.column("name").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("kind"), batch.column("n"), tokens], names=["name", "kind", "n", "tokens"])

    return names.select("name", "kind", "n").mapInArrow(run, "name string, kind string, n long, tokens array<string>")


def _classes(spellings: DataFrame) -> DataFrame:
    """name, kind, n, class_kind, tokens (canonical, in order), class (key)."""
    schema = "name string, kind string, n long, class_kind string, tokens array<string>, class string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [classified(t, k) for t, k in zip(batch.column("tokens").to_pylist(), batch.column("kind").to_pylist())]
            cols = [
                batch.column("name"), batch.column("kind"), batch.column("n"),
                pa.array([k for k, _ in done], pa.string()),
                pa.array([t for _, t in done], pa.list_(pa.string())),
                pa.array([k + " " + " ".join(sorted(t)) for k, t in done], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["name", "kind", "n", "class_kind", "tokens", "class"])

    return spellings.mapInArrow(run, schema)


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs of classes (a, b with tokens and counts) that are aligned: a, b, weight_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("ta", "tb", "ca", "cb", "fa", "fb")]
            keep = [
                aligned(ta, tb, {**dict(zip(ta, ca)), **dict(zip(tb, cb))}, {**dict(zip(ta, fa)), **dict(zip(tb, fb))}) for ta, tb, ca, cb, fa, fb in zip(*cols)
            ]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b"), kept.column("weight_b")], names=["a", "b", "weight_b"])

    return pairs.mapInArrow(run, "a string, b string, weight_b struct<full:int,n:bigint,class:string>")


def entities(mentions: DataFrame) -> DataFrame:
    """`mentions` has name and field. Rows name, kind, entity: the entity of each distinct
    spelling; kind `P`, `O` or `?` is what the field says."""
    field_kind = F.when(F.col("field").isin("inventors", "representative_name"), "P").when(F.col("field") == "representative_organization", "O").otherwise("?")
    names = mentions.filter("name is not null and trim(name) <> ''").groupBy("name", field_kind.alias("kind")).agg(F.count("*").alias("n"))
    spellings = cut(_spelling_tokens(names))

    # Tokens that are typing errors of very frequent ones (given names, common words).
    counted = spellings.select(F.explode("tokens").alias("token"), "n").filter("length(token) >= 4 and token not like '%.'").groupBy("token").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    frequent = counted.filter(F.col("n") >= COMMON).select(F.col("token").alias("head"), F.col("n").alias("head_n"), F.explode(_deleted(F.col("token"))).alias("cut"))
    heads = (
        counted.withColumn("cut", F.explode(_deleted(F.col("token"))))
        .join(frequent, "cut")
        .filter((F.col("head_n") >= COMMON * F.col("n")) & _close(F.col("token"), F.col("head")))
        .groupBy("token")
        .agg(F.max_by("head", F.struct("head_n", "head")).alias("head"))
    )
    # Only spellings that hold such a token are taken apart and put together again.
    touched = spellings.select("name", "kind", F.posexplode("tokens").alias("pos", "token")).join(heads, "token")
    fixes = touched.groupBy("name", "kind").agg(F.collect_list(F.struct("pos", "head")).alias("fixes"))
    mended = spellings.join(fixes, ["name", "kind"], "left").withColumn(
        "tokens",
        F.when(F.col("fixes").isNull(), F.col("tokens")).otherwise(
            F.transform("tokens", lambda t, i: F.coalesce(F.get(F.filter("fixes", lambda f: f["pos"] == i), F.lit(0))["head"], t))
        ),
    )
    spelt = cut(_classes(mended.select("name", "kind", "n", "tokens")))

    # Classes, token counts within kind, telling tokens.
    classes = spelt.groupBy("class", "class_kind").agg(F.sum("n").alias("n"), F.count("*").alias("forms"), F.first("tokens").alias("tokens"))
    tokens = classes.select("class_kind", "n", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("class_kind", "token").agg(F.sum("n").alias("token_n"))
    per_token = classes.select("class", "class_kind", F.posexplode("tokens").alias("pos", "token")).join(tokens, ["class_kind", "token"])
    described = per_token.groupBy("class", "class_kind").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "token_n"))).alias("parts"))
    classes = classes.select("class", "n", "forms").join(described, "class")
    classes = cut(classes.select("class", "class_kind", "n", "forms", "parts"))
    # Each part with the first letter of the other telling part: in an organisation the rarest
    # other token, in a person the first other one, which is the given name or its initial.
    others = F.filter("parts", lambda p: p["pos"] != F.col("t.pos"))
    rarest = F.array_min(F.transform(others, lambda p: F.struct(p["token_n"], p["token"])))["token"]
    other = F.when(F.col("class_kind") == "O", rarest).otherwise(F.get(others, F.lit(0))["token"])
    parts = classes.withColumn("t", F.explode("parts")).withColumn("letter", F.coalesce(F.substring(other, 1, 1), F.lit("")))
    parts = parts.select("class", "class_kind", "n", "forms", "t.pos", "t.token", "letter")
    # How well a spelling is attested: its mentions together with that letter, and the distinct
    # names among them, which copies of one mention don't add to.
    attested = parts.groupBy("class_kind", "token", "letter").agg(F.sum("n").alias("attested"), F.sum("forms").alias("among"))
    parts = cut(parts.join(attested, ["class_kind", "token", "letter"]))
    side = parts.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "attested", "among"))).alias("at"))
    side = cut(side.select("class", F.col("at.token").alias("tokens"), F.col("at.attested").alias("counts"), F.col("at.among").alias("forms")))

    # Every full token with the first letter of each other token; telling or not.
    letters = F.when(F.size("parts") > 1, F.array_distinct(F.transform(others, lambda p: F.substring(p["token"], 1, 1)))).otherwise(F.array(F.lit("")))
    full = classes.filter((F.size("parts") >= 2) | (F.col("class_kind") == "O")).withColumn("full", F.filter("parts", lambda p: ~p["token"].endswith(".")))
    full = full.withColumn("weight", F.struct(F.size("full").alias("full"), "n", "class")).withColumn("least", F.array_min("full.token_n")).withColumn("t", F.explode("full"))
    index = full.select("class_kind", "weight", "t.token", (F.col("t.token_n") <= RARE * F.col("least")).alias("telling"), F.explode(letters).alias("letter"))
    index = cut(index.groupBy("class_kind", "weight", "token", "letter").agg(F.max("telling").alias("telling")))

    # Candidates: classes that have tokens within one edit, telling in one of them, and the letter;
    # each pair once, from the lighter class to the weightier one.
    met = index.filter("telling").join(_neighbours(index.select("class_kind", "token").distinct()), ["class_kind", "token"]).select("class_kind", "letter", F.col("other").alias("token"), F.col("weight").alias("x"))
    met = met.join(index.select("class_kind", "letter", "token", F.col("weight").alias("y")), ["class_kind", "letter", "token"])
    met = met.filter("x <> y").select(F.least("x", "y").alias("weight_a"), F.greatest("x", "y").alias("weight_b"))
    candidates = met.select(F.col("weight_a.class").alias("a"), F.col("weight_b.class").alias("b"), "weight_b").distinct()
    candidates = candidates.join(side.toDF("a", "ta", "ca", "fa"), "a").join(side.toDF("b", "tb", "cb", "fb"), "b")
    links = _verified(candidates).groupBy("a").agg(F.max_by("b", "weight_b").alias("parent"))
    roots = _followed(cut(links))
    return spelt.join(roots.toDF("class", "root"), "class", "left").select("name", "kind", F.coalesce("root", "class").alias("entity"))


def _neighbours(tokens: DataFrame) -> DataFrame:
    """class_kind, token, other: the tokens (distinct) that `_match` may take for one, the token
    itself included. Symmetric deletion on distinct tokens, so names meet by whole tokens."""
    plain = lambda c: F.regexp_replace(c, "([aou])e", "$1")
    forms = F.when(F.length("token") >= 4, F.array_union(_deleted(F.col("token")), _deleted(plain(F.col("token"))))).otherwise(F.array_distinct(F.array("token", plain(F.col("token")))))
    cuts = tokens.select("class_kind", "token", F.explode(forms).alias("cut"))
    both = cuts.join(cuts.withColumnRenamed("token", "other"), ["class_kind", "cut"])
    a, b = F.col("token"), F.col("other")
    long = (F.length(a) >= 4) & (F.length(b) >= 4)
    fits = (a == b) | (plain(a) == plain(b)) | (long & (_close(a, b) | _close(plain(a), plain(b))))
    return both.filter(fits).select("class_kind", "token", "other").distinct()


def _followed(links: DataFrame) -> DataFrame:
    """(a, root): links to a weightier class followed to the end by pointer jumping; weights
    rise along a chain, so there are no cycles and the chain's length halves each round."""
    at = links.toDF("a", "root")
    for _ in range(40):
        step = at.select(F.col("a").alias("root"), F.col("root").alias("beyond"))
        after = cut(at.join(step, "root", "left").select("a", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        at = after.select("a", "root")
        if after.filter("moved").limit(1).count() == 0:
            break
    return at


def linked(mentions: DataFrame) -> DataFrame:
    """mention_id, entity_id (smallest mention_id of the entity), mentions (of the entity): one
    row for each mention with a name."""
    field_kind = F.when(F.col("field").isin("inventors", "representative_name"), "P").when(F.col("field") == "representative_organization", "O").otherwise("?")
    rows = mentions.filter("name is not null").select("mention_id", "name", field_kind.alias("kind"))
    rows = cut(rows.join(entities(mentions), ["name", "kind"]).select("mention_id", "entity"))
    groups = rows.groupBy("entity").agg(F.min("mention_id").alias("entity_id"), F.count("*").alias("mentions"))
    return rows.join(groups, "entity").select("mention_id", "entity_id", "mentions")


def found(mentions: DataFrame) -> DataFrame:
    """Pairs (mention_id_a, mention_id_b) of the mentions of one entity."""
    rows = cut(linked(mentions).filter("mentions > 1").select("mention_id", "entity_id"))
    a, b = rows.toDF("mention_id_a", "entity_id"), rows.toDF("mention_id_b", "entity_id")
    return a.join(b, "entity_id").filter("mention_id_a < mention_id_b").select("mention_id_a", "mention_id_b")


def probed(mentions: DataFrame, every: int = 50) -> DataFrame:
    """query_id, mention_id: for each mention whose id is divisible by `every` all other mentions
    of its entity, searched among all rows."""
    rows = cut(linked(mentions).select("mention_id", "entity_id"))
    asked = rows.filter(F.col("mention_id") % every == 0).select(F.col("mention_id").alias("query_id"), "entity_id")
    return asked.join(rows, "entity_id").filter("query_id <> mention_id").select("query_id", "mention_id")
