"""Personal data replaced by keyed surrogates of the same type, format, script and gender."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens.llm.shared import Scratch, bound

#: Titles that announce a name, by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sir", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Madam", "Госпожа", "Κυρία")
#: In any case, except that "miss" in lower case is a verb.
TITLE = "(?!miss)(?iu:" + "|".join((*FEMALE, *MALE)) + ")\\.? "
NAME = r"\p{Lu}[\p{L}'-]+"
#: Parts of made-up names by script: heads, links, and the endings of male, female and family names.
SYLLABLES = {
    "latin": ("Ba Be Bo Ca Da De Do Fa Fe Ga Ha Jo Ka La Le Lo Ma Me Mo Na No Pa Ra Re Ro Sa Se Ta To Va Wa Za", "bel dan dor fin gar har kel lan len lin mar mel mon nar nel ran rel rin ron sel sen tan tel tor val van vin war wen zan zel zin", "o us el an", "a ia ina ela", "er son mann ez"),
    "cyrillic": ("Ба Бо Ва Га Да До За Ка Ко Ла Ма Ми На Но Па Ра Ро Са Та То", "бел вад гор дан зар кир лав лен мир нал рад рин сав тал тор вин", "ан ей ил ор", "а ия ина ела", "ов ин ский ко"),
    "greek": ("Βα Γα Δα Ζα Κα Λα Μα Να Πα Ρα Σα Τα Φα Χα", "βελ γαρ δαν ζαν καλ λαν μαρ ναλ παλ ραν σαλ ταν φιν χαρ", "ος ης ας ων", "α η ια ινα", "ου ιδης ακης πουλος"),
}
EDGE, STOP = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: (type, expression of a mention, expression of the prefix that stays). The first that fits names the type.
ENTITIES = (
    ("email", r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z._%+-]{1,64}@[0-9A-Za-z](?:[0-9A-Za-z-]*[0-9A-Za-z])?(?:\.[0-9A-Za-z-]*[0-9A-Za-z])+", ""),
    ("secret", r"(?i:password|passwd|secret|token|api_key)[\x20]?[=:][\x20]?[\"']?[0-9A-Za-z_./+-]{6,}", r"[A-Za-z_]+[\x20]?[=:][\x20]?[\"']?"),
    ("key", EDGE + r"A[KS]IA[0-9A-Z]{16}" + STOP, "A[KS]IA"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ""),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", ""),
    ("phone", r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9])", ""),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])", ""),
    ("iban", EDGE + r"[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?:\x20?[0-9A-Z]{1,3})?" + STOP, "[A-Z]{2}"),
    ("card", r"(?<![0-9A-Za-z.-])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])", ""),
    ("name", EDGE + TITLE + NAME + f"(?: {NAME})?", TITLE),
)
ANY = "|".join(f"(?:{e})" for _, e, _ in ENTITIES)
ROUNDS = 64
#: Tries in the mention's own form. After them the space of a type grows with each try, or takes all valid values.
OWN_FORM = 4


def kind_of(mention: Column) -> Column:
    return reduce(lambda rest, e: F.when(F.regexp_like(mention, F.lit(f"^(?:{e[1]})$")), F.lit(e[0])).otherwise(rest), reversed(ENTITIES), F.lit(None))


def prefix_of(kind: Column, mention: Column) -> Column:
    kept = F.lit("")
    for name, _, prefix in ENTITIES:
        if prefix:
            kept = F.when(kind == name, F.regexp_extract(mention, f"^(?:{prefix})", 0)).otherwise(kept)
    return kept


def alnum(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9A-Za-z]", "")


def at(c: Column, i: Column) -> Column:
    return F.substring(c, i + 1, F.lit(1))


def pick(digest: Column, i: Column, size: int) -> Column:
    """The i-th draw from 0 to size - 1 of a digest, four hex digits each."""
    return F.pmod(F.conv(F.substring(digest, 4 * i + 1, F.lit(4)), 16, 10).cast("int"), F.lit(size))


def drawn(core: Column, digest: Column) -> Column:
    """Each digit and letter replaced by one of its class; hexadecimal words stay hexadecimal."""
    hexes = F.regexp_like(core, F.lit("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{12,}$"))

    def one(i: Column) -> Column:
        c = at(core, i)
        return F.when(hexes, at(F.lit("0123456789abcdef"), pick(digest, i, 16))).when(F.regexp_like(c, F.lit("[0-9]")), pick(digest, i, 10).cast("string")).when(
            F.regexp_like(c, F.lit("[a-z]")), F.char(97 + pick(digest, i, 26))).when(F.regexp_like(c, F.lit("[A-Z]")), F.char(65 + pick(digest, i, 26))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(core), F.lit(1)) - 1), one), "")


def syllables(script: str, role: Column, digest: Column, more: Column) -> Column:
    """A made-up name with `more` further links."""
    heads, links, male, female, family = ([F.lit(x) for x in part.split()] for part in SYLLABLES[script])
    ends = {"m": male, "f": female, "family": family}
    word = F.concat(F.get(F.array(*heads), pick(digest, F.lit(0), len(heads))), F.get(F.array(*links), pick(digest, F.lit(1), len(links))), F.get(F.array(*links), pick(digest, F.lit(2), len(links))))
    ending = reduce(lambda rest, k: F.when(role == k, F.get(F.array(*ends[k]), pick(digest, F.lit(3), len(ends[k])))).otherwise(rest), ends, F.lit(""))
    further = F.transform(F.slice(F.sequence(F.lit(4), F.lit(31)), F.lit(1), more), lambda i: F.get(F.array(*links), pick(digest, i, len(links))))
    return F.concat(word, F.array_join(further, ""), ending)


def surrogate(kind: Column, canon: Column, digest: Column, tries: Column) -> Column:
    """The replacement of a unit in canonical form. Cards keep their first digit and whether their check digit is
    right, email addresses move to example domains, address parts keep their digits' number. From the OWN_FORM-th try on domains get a drawn label, names further
    syllables and other words further letters, one more each time; addresses and numbers of people any valid value."""
    more = F.least(F.greatest(tries - OWN_FORM + 1, F.lit(0)), F.lit(24))
    letters = F.array_join(F.transform(F.slice(F.sequence(F.lit(0), F.lit(23)), F.lit(1), more), lambda i: F.char(97 + pick(F.sha2(F.concat(digest, F.lit("more")), 512), i, 26))), "")
    any_drawn = F.concat(drawn(canon, digest), F.when(kind == "secret", letters).otherwise(F.lit("")))
    body = F.concat(F.substring(canon, 1, 1), drawn(F.expr("substring(canon, 2, length(canon) - 2)"), digest))
    right = F.get(F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.call_function("luhn_check", F.concat(body, d))), F.lit(0))
    wrong = F.pmod(right.cast("int") + 1 + pick(digest, F.lit(31), 9), F.lit(10)).cast("string")
    card = F.concat(body, F.when(F.call_function("luhn_check", canon), right).otherwise(wrong))
    octet = lambda o, i: F.when(more > 0, 1 + pick(digest, i, 255)).when(F.length(o) == 1, 1 + pick(digest, i, 9)).when(F.length(o) == 2, 10 + pick(digest, i, 90)).otherwise(100 + pick(digest, i, 156)).cast("string")
    ip = F.array_join(F.transform(F.split(canon, "\\."), octet), ".")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    labels = F.split(domain, "\\.")
    inner = drawn(F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), "."), F.sha2(digest, 512))
    top = F.substring_index(domain, ".", -1)
    host = F.concat(F.lit("example."), F.when(top.isin("com", "net", "org"), top).otherwise(F.lit("com")))
    host = F.when(more > 0, F.concat(letters, F.lit("."), host)).otherwise(host)
    email = F.concat(drawn(local, digest), F.lit("@"), F.when(F.size(labels) > 2, F.concat(inner, F.lit("."), host)).otherwise(host))
    role = F.substring_index(kind, "-", -1)
    script = F.when(F.regexp_like(canon, F.lit("\\p{IsCyrillic}")), syllables("cyrillic", role, digest, more)).when(F.regexp_like(canon, F.lit("\\p{IsGreek}")), syllables("greek", role, digest, more)).otherwise(syllables("latin", role, digest, more))
    lead = lambda least: F.when(more > 0, pick(digest, F.lit(0), 10)).otherwise(least).cast("string")
    phone = F.concat(lead(1 + pick(digest, F.lit(0), 9)), drawn(F.expr("substring(canon, 2)"), F.sha2(digest, 512)))
    ssn = F.concat(lead(F.lit(9)), drawn(F.expr("substring(canon, 2)"), F.sha2(digest, 512)))
    return F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind.startswith("name"), script).otherwise(any_drawn)


def units(kind: Column, core: Column, prefix: Column) -> Column:
    """What of a mention is replaced as one: (kind, canon). Names are replaced word by word, so a name in full
    and by family name alone stay one person; forms of one number, or of one address in other case, are one."""
    title = F.regexp_replace(prefix, "\\.? $", "")
    gender = F.when(F.lower(title).isin(*[t.lower() for t in FEMALE]), F.lit("name-f")).otherwise(F.lit("name-m"))
    words = F.split(core, " ")
    named = F.transform(words, lambda w, i: F.struct(F.when((i == 0) & (F.size(words) > 1), gender).otherwise(F.lit("name-family")).alias("kind"), w.alias("canon")))
    digits = alnum(core)
    canon = F.when(kind == "email", F.lower(core)).when(kind == "phone", F.right(digits, F.lit(10))).when(kind.isin("card", "ssn", "iban"), digits).otherwise(core)
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))


def formatted(kind: Column, core: Column, replaced: Column) -> Column:
    """The surrogate in the mention's own spacing, signs and case; `replaced` has that of each unit."""
    first = F.get(replaced, F.lit(0))
    digits = alnum(core)
    stream = F.concat(F.when(kind == "phone", F.expr("substring(regexp_replace(core, '[^0-9A-Za-z]', ''), 1, greatest(length(regexp_replace(core, '[^0-9A-Za-z]', '')) - 10, 0))")).otherwise(F.lit("")), first)
    place = lambda i: F.length(alnum(F.substring(core, F.lit(1), i)))
    shaped = F.array_join(F.transform(F.sequence(F.lit(0), F.length(core) - 1), lambda i: F.when(F.regexp_like(at(core, i), F.lit("[0-9A-Za-z]")), at(stream, place(i))).otherwise(at(core, i))), "")
    upper = (kind == "email") & (core == F.upper(core))
    plain = F.when(upper, F.upper(first)).otherwise(F.array_join(replaced, " "))
    return F.when(kind.isin("phone", "card", "ssn", "iban") & (digits != ""), shaped).otherwise(plain)


def assign(units_seen: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, canon, surrogate): distinct units get distinct surrogates, none of which is itself a unit seen.

    Each draw is a keyed digest of the unit and the number of its tries. Of units that drew the same surrogate
    the first by text keeps it; the others, and those that hit a real unit, draw again until none is left. The space
    grows with the tries, so a full one ends nothing; ROUNDS is reached only if all valid values are in use."""
    known = scratch.keep(units_seen.distinct(), "units")

    def draw(df: DataFrame) -> DataFrame:
        seeded = lambda b: F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", F.col("tries").cast("string"), b.cast("string")), 512)
        long = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length("canon") / 32).cast("int")), seeded), "")
        return bound(bound(df.select("kind", "canon", "tries"), digest=long), surrogate=surrogate(F.col("kind"), F.col("canon"), F.col("digest"), F.col("tries"))).drop("digest")

    state = scratch.keep(draw(known.withColumn("tries", F.lit(0))), "draw-0")
    real = known.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
    for turn in range(1, ROUNDS + 1):
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("tries", "canon"))
        marked = state.withColumn("rank", rank).join(real, ["kind", "surrogate"], "left")
        marked = marked.withColumn("clash", (F.col("rank") > 1) | F.col("real").isNotNull())
        marked = scratch.keep(marked.select("kind", "canon", "tries", "surrogate", "clash"), f"marked-{turn}")
        clashing = marked.where("clash")
        if clashing.isEmpty():
            return marked.select("kind", "canon", "surrogate")
        again = draw(clashing.withColumn("tries", F.col("tries") + 1))
        state = scratch.keep(marked.where("not clash").select("kind", "canon", "tries", "surrogate").unionByName(again), f"draw-{turn}")
        scratch.drop(f"draw-{turn - 1}")
    raise ValueError("too many entities of one format for distinct surrogates")


def replace_entities(docs: DataFrame, key: str, scratch: Scratch | None = None) -> DataFrame:
    """The documents with personal data in `text` replaced, all other columns as they are, and n_entities added.

    Equal entities get equal surrogates in all documents, different ones different ones. Null and empty texts
    stay; repeated rows give equal rows. The key is secret: without it surrogates can't be traced back."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "pii")
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0))
    staged = scratch.keep(docs.select(held.alias("held"), F.coalesce(found, F.array().cast("array<string>")).alias("mentions")), "rows")
    lists = staged.where(F.size("mentions") > 0).select("mentions").distinct()
    each = lists.select("mentions", F.posexplode("mentions").alias("pos", "mention"))
    seen = bound(each.select("mention").distinct(), kind=kind_of(F.col("mention")))
    seen = bound(seen, prefix=prefix_of(F.col("kind"), F.col("mention")))
    seen = bound(seen, core=F.expr("substring(mention, length(prefix) + 1)"))
    seen = scratch.keep(bound(seen, units=units(F.col("kind"), F.col("core"), F.col("prefix"))), "mentions")
    exploded = seen.select("mention", F.posexplode("units").alias("place", "unit")).select("mention", "place", "unit.*")
    named = assign(exploded.select("kind", "canon"), key, scratch)
    replaced = exploded.join(named, ["kind", "canon"]).groupBy("mention").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "surrogate"))), lambda x: x["surrogate"]).alias("replaced"))
    shaped = seen.join(replaced, "mention").select("mention", F.concat("prefix", formatted(F.col("kind"), F.col("core"), F.col("replaced"))).alias("surrogate"))
    shaped = scratch.keep(shaped, "surrogates")
    swapped = each.join(shaped, "mention").groupBy("mentions").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "surrogate"))), lambda x: x["surrogate"]).alias("surrogates"))
    rich = staged.where(F.size("mentions") > 0).join(swapped, "mentions")
    pieces = F.split(F.col("held.text"), ANY, -1)
    text = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get("surrogates", i), F.lit("")))), "")
    changed = rich.select(F.col("held").withField("text", text).alias("held"), F.size("mentions").cast("long").alias("n"))
    same = staged.where(F.size("mentions") == 0).select("held", F.lit(0).cast("long").alias("n"))
    return changed.union(same).select("held.*", F.col("n").alias("n_entities"))
