"""Problem 7: variant spellings of names.

Merge and rematch: every entity starts as the profile of its listed spellings.  A form is looked up by the one-letter
deletions of its words (two words within one edit share such a key), and compared with a spelling word for word: order,
titles, articles, transliteration, initials, abbreviations, nicknames and one typing error per word are allowed for, at a
cost.  A form that has one cheapest entity is merged: its spelling, with its initials, joins the entity's profile at that
cost, and the richer profiles are looked up again by the forms that are left, until a round merges nothing.

Any word of a spelling is looked up by itself, as long as few entities share it or it is the spelling's rarest; a word
that more share is looked up together with the first letter of another one, which initials and short forms keep, so a
common given name alone does not bring all its bearers together.

Only distinct forms and the spellings of entities are shuffled; a form that a third of all mentions use is one row.  Forms
that name nobody listed are grouped among themselves in the same way (``group_unknown``).

Defined results: null and empty forms name nobody; a form whose cheapest entities tie names nobody; repeated mentions
have the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.forms import visual_form
from tidewatch.operators.graphs import components
from tidewatch.session import cut

# Titles before names.
TITLES = set("dr mr mrs ms miss sir gen general col minister prof professor sheikh president الدكتور الدكتوره السيد السيده اللواء العميد الوزير الشيخ الرييس الاستاذ المهندس".split())
# Words that join the parts of a name.
JOINING = set("the of in at for and de la du في من ب بمدينه مدينه بن".split())
# Given names by their short forms.
SHORT_FORMS = {
    "abdulrahman": "abdo abdu abd abdou", "mohammed": "mo moh hamada mido", "robert": "bob rob bobby robbie bert", "fatima": "fatoum fatma fattouma tima",
    "yusuf": "joe youssef joseph jo", "gabriel": "gabe gabi jibril", "margaret": "peggy maggie meg marge", "william": "bill will billy liam",
    "katherine": "kate kathy katie kit cathy", "elizabeth": "liz beth eliza lisa betty", "alexander": "alex sasha sandy xander", "ibrahim": "abe ibra bram brahim",
    "nadia": "nadi nadou", "leila": "lulu lily", "tariq": "taro", "zaynab": "zuzu zizi zouzou", "hassan": "hass hasoon", "omar": "omari amoura", "salim": "sal sel", "dawud": "dave daoud dawd",
    "عبدالرحمن": "عبدو عبده عبود", "محمد": "حماده ميدو حمودي", "روبرت": "بوب", "فاطمه": "فطوم فطومه", "يوسف": "جو", "مارغريت": "بيغي ماغي", "ويليام": "بيل",
    "كاثرين": "كيت", "اليزابيث": "ليز", "الكسندر": "اليكس", "جبريل": "غيب",
}
# Arabic letters that are written for one another.
SPELLINGS = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ی": "ي", "ئ": "ي", "ؤ": "و", "ة": "ه", "ک": "ك", "ـ": None} | {chr(c): None for c in range(0x64B, 0x660)} | {"ٰ": None})
_ARTICLE = re.compile(r"\b(?:[AaEe][Ll])(?:[-‐–\s]+(?=\w)|(?=[A-Z][a-z]))|\bA[Ll]-|(?<!\w)ال\s+(?=\w)")
_WORD = re.compile(r"[^\W_]+")


@lru_cache(200_000)
def fold_word(word: str) -> str:
    """A word without differences of transliteration and doubled letters."""
    if word.isascii():
        for a, b in (("ou", "u"), ("oo", "u"), ("ee", "i"), ("q", "k"), ("ph", "f"), ("y", "i")):
            word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


def words_of_name(form: str | None) -> list[str]:
    """The words of a form in lower case, without titles, articles and joining words."""
    seen = visual_form(form) or ""
    if re.fullmatch(r"(?:[A-Z]\.?){2,6}", seen) and (seen.isupper() and ("." in seen or len(seen) <= 5)):
        return ["=" + seen.replace(".", "").lower()]
    bare = _ARTICLE.sub("", seen).casefold().translate(SPELLINGS).replace("'", "").replace("’", "")
    raw = [w for w in _WORD.findall(bare) if w not in TITLES and w not in JOINING]
    return [w[2:] if len(w) >= 5 and w.startswith("ال") else w for w in raw if w not in ("al", "el", "ال")]


def typing_errors(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, row = row, now
    return min(row[-1], most + 1)


_SHORT = {s.translate(SPELLINGS): full.translate(SPELLINGS).removeprefix("ال") for full, shorts in SHORT_FORMS.items() for s in shorts.split()}


def _word_cost(mine: str, theirs: str, is_org: bool, anchor: bool) -> float | None:
    if mine == theirs:
        return 0.0
    if mine[0] == "=" or theirs[0] == "=":
        return None
    a, b = fold_word(mine), fold_word(theirs)
    if a == b and len(a) >= 3:
        return 0.1
    if len(mine) >= 4 and len(theirs) >= 4 and (typing_errors(mine, theirs, 1) == 1 or typing_errors(a, b, 1) == 1):
        return 1.0
    if anchor:
        return None
    if is_org:
        short = 2 <= len(mine) <= 5 and len(mine) < len(theirs) and mine[0] == theirs[0]
        rest = iter(theirs)
        return 0.5 if short and all(c in rest for c in mine) else None
    if len(mine) == 1 and theirs[:1] == mine:
        return 0.6
    if mine in _SHORT and fold_word(_SHORT[mine]) == b:
        return 0.3
    return None


def cheapest_pairing(costs: list[list[float | None]]) -> list[int] | None:
    """For each row the column of the cheapest one-to-one pairing; None if there is none.  Shortest augmenting paths."""
    n, far = len(costs), 1e9
    if n <= 2:  # most names
        ways = [way for way in ([*range(n)], [*range(n)][::-1]) if all(costs[i][j] is not None for i, j in enumerate(way))]
        return min(ways, key=lambda way: sum(costs[i][j] for i, j in enumerate(way)), default=None)
    value = lambda i, j: far if costs[i][j] is None else costs[i][j]
    row_price, column_price, owner = [0.0] * n, [0.0] * n, [-1] * n
    for start in range(n):
        reach, came, done = [float("inf")] * n, [-1] * n, [False] * n
        row, column = start, -1
        while row >= 0:
            if column >= 0:
                done[column] = True
            step, nearest = float("inf"), -1
            for j in range(n):
                if done[j]:
                    continue
                now = value(row, j) - row_price[row] - column_price[j]
                if now < reach[j]:
                    reach[j], came[j] = now, column
                if reach[j] < step:
                    step, nearest = reach[j], j
            row_price[start] += step
            for j in range(n):
                if done[j]:
                    row_price[owner[j]] += step
                    column_price[j] -= step
                else:
                    reach[j] -= step
            column, row = nearest, owner[nearest]
        while column >= 0:
            before = came[column]
            owner[column] = owner[before] if before >= 0 else start
            column = before
    out = [owner.index(i) for i in range(n)]
    return out if all(costs[i][j] is not None for i, j in enumerate(out)) else None


def match_cost(mine: list[str], theirs: list[str], anchor: str, is_org: bool, most: float = 2.2) -> tuple[float, str] | None:
    """Cost of reading the form's words as the spelling's, and the form's own word for the anchor; None above ``most``."""
    if len(mine) != len(theirs):  # a space lost or too many
        a, b = "".join(mine), "".join(theirs)
        near = abs(len(mine) - len(theirs)) == 1 and len(a) >= 8 and typing_errors(a, b, 1) <= 1
        return (1.0 + (a != b), anchor) if near else None
    if len(mine) == 1 and is_org and not mine[0].startswith("="):
        return None
    costs = [[_word_cost(m, t, is_org, t == anchor) for t in theirs] for m in mine]
    pairing = cheapest_pairing(costs)
    if pairing is None:
        return None
    total = sum(costs[i][j] for i, j in enumerate(pairing))
    own = next((mine[i] for i, j in enumerate(pairing) if theirs[j] == anchor), "")
    return (total, own) if total <= most else None


def deletion_keys(word: str) -> set[str]:
    """The word and its folded form, and all they become by losing one letter."""
    if word[0] == "=":
        return {word}
    return {k for w in {word, fold_word(word)} for k in ({w} | ({w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) >= 4 else set()))}


def _spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(words=[words_of_name(f) for f in b["form"]])


def first_letters(word: str) -> set[str]:
    """What a word and the name it may be short for begin with."""
    full = _SHORT.get(word)
    return {w[0] for w in (fold_word(word), fold_word(full) if full else "") if w and w[0] != "="}


def _form_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A form under each of its words, alone and with the first letter of another one."""
    for b in batches:
        rows = []
        for i, words in enumerate(b["words"]):
            keys = set()
            for n, w in enumerate(words):
                letters = {x for k, o in enumerate(words) if k != n for x in first_letters(o)}
                keys |= {k + tail for k in deletion_keys(w) for tail in ("", *(f"+{x}" for x in letters))}
            rows += [(i, k) for k in sorted(keys)]
        yield b.iloc[[i for i, _ in rows]].assign(key=[k for _, k in rows])


def _spelling_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spelling under its anchor; a shared one with the first letters of the other words."""
    for b in batches:
        rows = []
        for i, (names, anchor, shared) in enumerate(zip(b["names"], b["anchor"], b["shared"])):
            tails = {f"+{x}" for o in names if o != anchor for x in first_letters(o)} if shared else {""}
            rows += [(i, k + tail) for k in sorted(deletion_keys(anchor)) for tail in sorted(tails)]
        yield b.iloc[[i for i, _ in rows]].assign(key=[k for _, k in rows])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for form, words, entity, names, anchor, is_org, paid in zip(b["form"], b["words"], b["entity_id"], b["names"], b["anchor"], b["is_org"], b["paid"]):
            got = match_cost(list(words), list(names), anchor, is_org)
            if got is not None and got[0] + paid <= DRIFT:
                out.append((form, list(words), entity, is_org, got[0] + paid, got[1] or anchor))
        yield pd.DataFrame(out, columns=["form", "words", "entity_id", "is_org", "cost", "anchor"])


#: How far a merged spelling may be from a listed one in all, as ``match_cost`` counts along the way.
DRIFT = 3.0
_SPELLING = "entity_id long, is_org boolean, names array<string>, anchor string, shared boolean, paid double"


def _initials(entities: DataFrame) -> DataFrame:
    """The initials of organisations' names, where no other organisation has them."""
    parts = F.filter(F.split(F.regexp_replace("form", r"[^\p{L} ]", " "), " +"), lambda w: w.rlike("^[A-Z]"))
    made = entities.where("is_org").select("entity_id", F.lower(F.array_join(F.transform(parts, lambda w: F.substring(w, 1, 1)), "")).alias("letters")).where(F.length("letters") >= 3)
    alone = made.groupBy("letters").agg(F.min("entity_id").alias("entity_id"), F.countDistinct("entity_id").alias("n")).where("n = 1")
    return alone.select("entity_id", F.lit(True).alias("is_org"), F.concat(F.lit("="), "letters").alias("abbreviation"))


def _profiles(spelt: DataFrame, shared_by: int) -> DataFrame:
    """Spellings (entity_id, is_org, names) with each of their words as anchor; ``shared`` where many entities have it."""
    single = spelt.withColumn("word", F.explode("names"))
    often = single.groupBy("word").agg(F.countDistinct("entity_id").alias("n"))
    by = F.sort_array(F.collect_set(F.struct("n", "word")))
    least = single.where(F.length("word") > 1).join(often, "word").groupBy("entity_id", "is_org", "names").agg(by.alias("by"))
    anchors = F.explode(F.transform("by", lambda x: F.struct(x["word"].alias("word"), ((x["n"] > shared_by) & (x["n"] > F.col("by")[0]["n"])).alias("shared"))))
    return least.select("entity_id", "is_org", "names", anchors.alias("a")).select("entity_id", "is_org", "names", F.col("a.word").alias("anchor"), "a.shared", F.lit(0.0).alias("paid"))


def _even(df: DataFrame) -> DataFrame:
    """Rows over a fixed number of tasks: they take Python time however few bytes they are."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 8))


def _costs(left: DataFrame, profiles: DataFrame) -> DataFrame:
    """(form, entity_id, best) of the forms and the spellings they can be read as, cheapest spelling per entity."""
    keyed = profiles.mapInPandas(_spelling_keys, _SPELLING + ", key string")
    # As match_cost demands: as many words, or one more or less and then nearly as many letters.
    letters = lambda c: F.length(F.array_join(c, ""))
    apart = F.abs(F.size("words") - F.size("names"))
    able = (apart == 0) | (apart == 1) & (F.abs(letters("words") - letters("names")) <= 1)
    met = _even(left.join(keyed, "key").where(able).drop("key").distinct())
    costed = met.mapInPandas(_compare, "form string, words array<string>, entity_id long, is_org boolean, cost double, anchor string")
    return costed.groupBy("form", "entity_id").agg(F.min(F.struct("cost", "words", "is_org", "anchor")).alias("best"))


def _asked(forms: DataFrame) -> DataFrame:
    """Distinct forms with their words and keys."""
    spelt = _even(forms.where(F.col("form").isNotNull()).select("form").distinct()).mapInPandas(_spell, "form string, words array<string>").where(F.size("words") > 0)
    return cut(spelt.mapInPandas(_form_keys, "form string, words array<string>, key string"))


def link_names(forms: DataFrame, spellings: DataFrame, shared_by: int = 8) -> DataFrame:
    """(form, entity_id) of every form that names one entity.

    ``forms``: form.  ``spellings``: entity_id, is_org, form (names and aliases).
    """
    known = spellings.where(F.col("form").isNotNull()).select(F.col("entity_id").cast("long").alias("entity_id"), "is_org", "form").distinct()
    spelt = known.mapInPandas(_spell, "entity_id long, is_org boolean, form string, words array<string>").where(F.size("words") > 0)
    listed = spelt.where(F.col("words")[0].startswith("=")).select(F.col("words")[0].alias("abbreviation")).distinct()
    made = _initials(known).join(listed, "abbreviation", "left_anti")
    full = spelt.select("entity_id", "is_org", F.col("words").alias("names")).unionByName(made.select("entity_id", "is_org", F.array("abbreviation").alias("names"))).distinct()
    fresh, left = cut(_profiles(full, shared_by)), _asked(forms)
    linked = None
    while True:
        cheapest = _costs(left, fresh).select("form", F.struct(F.col("best.cost").alias("cost"), "entity_id", "best").alias("x"))
        # The two cheapest entities of a form decide; more of them are never gathered.
        first = cheapest.groupBy("form").agg(F.min("x").alias("x"))
        second = cheapest.join(first.select("form", F.col("x").alias("y")), "form").where(F.col("x") > F.col("y")).groupBy("form").agg(F.min("x.cost").alias("next"))
        sole = first.join(second, "form", "left").where(F.col("next").isNull() | (F.col("x.cost") < F.col("next") - 1e-9))
        merged = cut(sole.select("form", F.col("x.entity_id").cast("int").alias("entity_id"), "x.best"))
        now = merged.select("form", "entity_id")
        linked = now if linked is None else linked.unionByName(now)
        if merged.isEmpty():
            return linked
        union = merged.select(F.col("entity_id").cast("long").alias("entity_id"), F.col("best.is_org").alias("is_org"), F.col("best.words").alias("names"), F.col("best.anchor").alias("anchor"), F.lit(False).alias("shared"), F.col("best.cost").alias("paid"))
        union = union.where((F.size("names") > 1) & (F.length("anchor") > 1))
        fresh = union.groupBy("entity_id", "is_org", "names").agg(F.min("anchor").alias("anchor"), F.min("shared").alias("shared"), F.min("paid").alias("paid"))
        left = cut(left.join(merged.select("form"), "form", "left_anti"))


def group_unknown(forms: DataFrame, shared_by: int = 8) -> DataFrame:
    """(form, group): forms of the same unlisted name under the least of them.

    Each form is a profile of its own; two that read as each other are linked, and linked ones form a group.
    """
    left = _asked(forms)
    alone = left.select("form", "words").distinct()
    profiles = _profiles(alone.select(F.xxhash64("form").alias("entity_id"), F.lit(False).alias("is_org"), F.col("words").alias("names")), shared_by)
    names = alone.select(F.xxhash64("form").alias("entity_id"), F.col("form").alias("other"))
    # No further than one typing error: chains of worse readings would lead from name to name.
    read = _costs(left, cut(profiles)).where(F.col("best.cost") <= 1.0).join(names, "entity_id").where("form <> other")
    roots = components(read.select("form", "other"), "form", "other")
    return alone.select("form").join(roots.withColumnRenamed("node", "form"), "form", "left").select("form", F.coalesce("root", "form").alias("group"))
