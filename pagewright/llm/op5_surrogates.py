r"""PII surrogates. DataFrame and SQL functions only.

Detected entities get replacements made from a keyed hash (SHA-256 of key, kind, entity, round): the same entity gets the same surrogate in every document and
in every spelling, and keeps its format.

kind      found as                                                     surrogate
secret    token/secret/password/key, = or :, a value of 8+ signs       value: letter for letter, digit for digit
apikey    AKIA or ASIA and 16 signs; ghp_, gho_ ... and 36+ signs      its beginning kept, the rest sign for sign
idno      passport, driving licence, identity card, tax id ... with a   letter for letter, digit for digit
          number behind it: up to 3 letters, 6 to 12 digits, a letter
email     local@domain                                                 local part and domain each, their last label kept
iban      country, 2 check digits, 11-30 signs (spaces allowed)        country kept, letter for letter, digit for digit
ip        four numbers up to 255, not behind "version", "release", "v" four numbers from 1 to 254
ipv6      eight groups of hexadecimal digits, or fewer around ::       hexadecimal digits, groups kept
phone     +country and groups; (area) number; 3-3-4 groups             digit for digit, country code kept; the same with and without +1
ssn       3-2-4 digits                                                 digit for digit
card      16 digits, or 13 to 19 that pass the Luhn check;             first digit kept; passes the Luhn check if the original does
          spaces or hyphens between
hexkey    32 or more hexadecimal digits                                hexadecimal digits
name      title, or words like "my name is" or "patient name:", and all  names made of syllables, endings by the title's gender, Latin or Cyrillic
          capitalised words behind it; a name's words without that in
          the same text

Entities are compared without case and, for numbers, without punctuation; a surrogate is written with the case and punctuation of the mention.
A letter becomes one of the same script (Latin, Latin with diacritics, Cyrillic, Greek). Words of a name are entities of their own, so
"Mr. Ann Example" and "Ms. Example" share the surrogate of "Example", and "Dr. Ann" and "Ms. Ann Example" that of "Ann" where it is no surname: a title isn't
part of an entity. A first name's ending follows the gender that the titles before it tell; where they tell none or both it is neutral. An O' or Mc stays. Domains are, too. Small particles (de, van, von, ...), hyphens, initials' full stops and
a final 's may stand in or behind a name and are kept. Untitled capitalised mentions of a word of a text's titled names get its surrogate (of the surname if it
is one, too), each counted as a mention; single letters and capitalised particles only get one behind a title.

The key comes from the caller or from the session's option spark.pagewright.surrogates.key; without either an application draws its own, so surrogates can't be
looked up, nor linked between applications.

Distinctness: two entities of a kind never share a surrogate, and none equals an entity of that kind in the data. Entities whose surrogate is taken (the
smallest keeps it) go to another round with a new hash; from round 6 on they also get a suffix of their own hash, so rounds end.

Scale: a cheap filter leaves out texts without digits, @, titles and the like; the others are searched once, and rows are written with what was found. Only documents with entities
are regrouped, by row, not by id. Entities are made distinct before any surrogate is computed; joins have one unique side, so a hot entity can be split.

Null texts stay null, empty ones empty; texts without entities come back unchanged. Repeated rows and ids are handled each for itself. All columns of docs are kept;
names beginning with __pii are this module's own. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import materialize, table

#: The session option that holds the key.
KEY_OPTION = "spark.pagewright.surrogates.key"
LATE_ROUND = 6

_MALE = "Mr|Mister|Herr|Herrn|Monsieur|Señor|Sr|Sir|господин|г-н"
_FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Srta|Sra|Lady|госпожа|г-жа"
_NEUTRAL = "Dr|Prof|Mx"
_TITLES = f"{_FEMALE}|{_MALE}|{_NEUTRAL}"
#: Words that tell that a name follows.
_CUES = "(?:[Mm]y|[Hh]is|[Hh]er|[Tt]heir)(?: full| first| last)? name is|(?:[Ff]ull|[Pp]atient|[Cc]ustomer|[Ee]mployee|[Aa]pplicant|[Cc]ardholder|[Aa]ccount [Hh]older)(?:['’]s)? [Nn]ame(?: is|:)"
_LEAD = rf"(?:(?:{_TITLES})\.?|{_CUES}) {{1,2}}"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: A capitalised word that is no title; a final 's isn't part of it.
_WORD = rf"(?!(?:{_TITLES})(?![\p{{L}}\p{{M}}]))\p{{Lu}}[\p{{L}}\p{{M}}]*+(?:['’](?![sS](?![\p{{L}}\p{{M}}]))[\p{{L}}\p{{M}}]++)*+"
_PARTICLES = "de|del|della|delle|dello|degli|dei|di|da|das|do|dos|du|des|la|las|le|les|lo|los|van|von|vom|zu|zum|zur|und zu|den|der|dem|het|ter|ten|te|tot|af|av|y|e|bin|bint|ibn|ben|abu|al|el|st"
_PARTICLE = rf"(?:(?:{_PARTICLES}) {{1,2}}|(?:d|l|dell|t)['’]|(?:al|el)-)*+"
#: Between words of a name: spaces, a hyphen, or an initial's full stop.
_BETWEEN = r"(?: {1,2}|-|(?<=[^\p{L}\p{M}]\p{Lu})\. {0,2})"
#: A word that may be a later mention of a name.
BARE = r"(?<![\p{L}\p{M}\p{N}])" + _WORD

#: Patterns in order of precedence.
PATTERNS = {
    "secret": r"(?<![\p{L}])(?i:token|secret|password|passwd|pwd|(?:api|access|secret)[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+.\-]{8,}+={0,2}",
    "apikey": r"(?<![\p{L}\p{N}])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+)" + _AFTER,
    "idno": _BEFORE + r"(?i:passport|driv(?:er['’]?s?|ing) licen[cs]e|(?:national|tax|insurance) id|(?:identity|id) card)(?i: (?:number|num|no|nr|id))?\.?(?:[:#] {0,2}| {1,2}#?)[A-Z]{0,3}\d{6,12}[A-Z]?" + _AFTER,
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,5}\.[\p{L}]{2,24}" + _AFTER,
    "iban": _BEFORE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _AFTER,
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[0-9a-fA-F:]*\d)(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}+)(?![\p{L}\p{N}:])",
    "ip": r"(?<![\p{L}\p{N}.])(?<!(?i:\b(?:version|release|ver|v)\.? ?))(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?[\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})" + _AFTER,
    "ssn": _BEFORE + r"\d{3}-\d{2}-\d{4}" + _AFTER,
    "card": _BEFORE + r"\d(?:[ -]?\d){12,18}" + _AFTER,
    "hexkey": _BEFORE + r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)" + _AFTER,
    "name": _BEFORE + rf"{_LEAD}{_PARTICLE}{_WORD}(?:{_BETWEEN}{_PARTICLE}{_WORD})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every text with an entity has.
HINT = rf"[0-9@=:]|(?:{_TITLES})\.? |name is "

#: Surrogate names: syllables, then an ending by gender.
SYLLABLES = {
    "latin": (["ba", "be", "bo", "ca", "co", "da", "de", "do", "fa", "fi", "ga", "go", "ha", "he", "ja", "jo", "ka", "ki", "la", "le", "lo", "ma", "me", "mi", "na", "no", "pa", "ra", "ri", "sa", "so", "ta"], {"m": ["ron", "bert", "nor", "mund", "rik", "lan", "ton", "vin"], "f": ["lia", "nna", "ria", "sha", "line", "tta", "vina", "rena"], "n": ["lin", "ris", "sky", "ren", "kim", "ley", "nell", "ray"], "x": ["man", "sen", "ford", "ley", "berg", "ton", "ster", "well"]}),
    "cyrillic": (["ба", "бе", "бо", "ва", "во", "га", "го", "да", "де", "до", "за", "зо", "ка", "ко", "ла", "ле", "ло", "ма", "ми", "мо", "на", "но", "па", "по", "ра", "ро", "са", "со", "та", "то", "фа", "ха"], {"m": ["мир", "слав", "рон", "вид", "рад", "лан", "тор", "вин"], "f": ["мира", "лина", "рена", "нна", "ля", "сия", "рада", "вета"], "n": ["рин", "лис", "рен", "ким", "ли", "рай", "тен", "ви"], "x": ["ко", "чук", "ник", "дзе", "швили", "янц", "вич", "юк"]}),
}
_ALPHABETS = {"^[0-9]$": "0123456789", "^[a-z]$": "abcdefghijklmnopqrstuvwxyz", r"^[ß-ɏ]$": "áéíóúàèìòùâêîôûäëïöüñç", r"^\p{IsCyrillic}$": "абвгдежзиклмнопрстуфхцчшэюя", r"^\p{IsGreek}$": "αβγδεζηθικλμνξοπρστυφχψω", r"^\p{L}$": "abcdefghijklmnopqrstuvwxyz"}


def _pick(options: list[str] | str, byte: Column) -> Column:
    items = list(options)
    return F.element_at(F.array(*(F.lit(x) for x in items)), (byte % len(items) + 1).cast("int"))


def _case(column: Column, cases: dict[str, Column], default: Column) -> Column:
    out = None
    for k, v in cases.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(default)


def kind_of(mention: Column) -> Column:
    out = None
    for k, p in PATTERNS.items():
        full = mention.rlike(rf"\A(?:{p})\z")
        out = F.when(full, k) if out is None else out.when(full, k)
    return out


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, however often lambdas in use need it."""
    return F.get(F.transform(F.array(value), use), 0)


def _alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def _entities(kind: Column, core: Column) -> Column:
    """The entities in a mention's core: kind, scope (within which surrogates must differ), norm (identity), shape (signs to replace), core, before (kept)."""

    def one(k: Column | str, scope: Column, norm: Column, shape: Column, c: Column, before: Column | None = None) -> Column:
        before = F.lit("") if before is None else before
        return F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), scope.alias("scope"), norm.alias("norm"), shape.alias("shape"), c.alias("core"), before.alias("before"))

    none = F.lit("")
    local, domain = F.substring_index(core, "@", 1), F.substring_index(core, "@", -1)
    stem = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    email = F.array(one("email", F.lower(domain), F.lower(core), _alnum(local), local), one("domain", F.regexp_extract(F.lower(domain), r"[^.]*$", 0), F.lower(domain), _alnum(stem), domain))
    words, gaps = F.regexp_extract_all(core, F.lit(_WORD), F.lit(0)), F.split(core, _WORD, -1)

    def name(w: Column, i: Column, n: Column, before: Column) -> Column:
        script = F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
        role = F.when(i == n - 1, "x").otherwise("g")
        return one(F.concat(F.lit("name-"), script, F.lit("-"), role), none, F.lower(w), F.lower(w), w, before)

    names = _with(F.struct(words.alias("words"), gaps.alias("gaps")), lambda x: F.transform(x["words"], lambda w, i: name(w, i, F.size(x["words"]), F.get(x["gaps"], i))))
    area = F.regexp_extract(core, r"^\+1[ .-]?(?=\D*\d{3}\D*\d{3}\D*\d{4}$)", 0)
    local_ = F.substr(core, F.length(area) + 1, F.length(core))
    phone = F.array(one("phone", none, _alnum(local_), _alnum(local_), local_, area))
    start = F.regexp_extract(core, "^(?:A[KS]IA|gh[pousr]_)", 0)
    rest = F.substr(core, F.length(start) + 1, F.length(core))
    apikey = F.array(one("apikey", none, core, F.lower(rest), rest, start))
    plain = F.array(one(kind, none, F.when(kind.isin("ip"), core).otherwise(_alnum(core)), F.when(kind.isin("ip"), core).otherwise(_alnum(core)), core))
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "apikey", apikey).when(kind.startswith("name"), names).otherwise(plain)


def _surrogate(kind: Column, norm: Column, shape: Column, gender: Column, turn: int, key: str) -> Column:
    """The surrogate for a shape in a round; gender (m, f, n) is that of a first name."""
    hashed = [F.sha2(F.concat_ws("\x01", F.lit(key), kind, norm, F.lit(f"{turn}:{n}")), 256) for n in range(3)]
    is_hex = kind.isin("hexkey", "ipv6") | (kind == "secret") & shape.rlike("^[0-9a-f]{16,}$")
    return _with(F.struct(F.concat(*hashed).alias("stream"), is_hex.alias("hex")), lambda once: _drawn(kind, norm, shape, gender, turn, once["stream"], once["hex"]))


def _drawn(kind: Column, norm: Column, shape: Column, gender: Column, turn: int, stream: Column, is_hex: Column) -> Column:
    def byte(i: Column) -> Column:
        return F.conv(F.substr(stream, (i % 96) * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def sign(c: Column, i: Column) -> Column:
        b = byte(i)
        out = F.when(is_hex & c.rlike("^[0-9a-f]$"), _pick("0123456789abcdef", b))
        keep = ((kind == "card") & (i == 0)) | ((kind == "iban") & (i < 2)) | ((kind == "phone") & (F.length(shape) > 10) & (i < F.length(shape) - 10))
        out = out.when(keep, c)
        for pattern, letters in _ALPHABETS.items():
            out = out.when(c.rlike(pattern), _pick(letters, b))
        return out.otherwise(c)

    signs = F.array_join(F.transform(F.filter(F.split(shape, ""), lambda c: c != ""), sign), "")
    digits = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: F.concat(F.substr(signs, F.lit(1), F.length(signs) - 1), x.cast("string")))
    card = F.when(F.call_function("luhn_check", shape), F.element_at(F.filter(digits, lambda x: F.call_function("luhn_check", x)), 1)).otherwise(signs)
    ip = F.concat_ws(".", *((byte(F.lit(n)) % 254 + 1).cast("string") for n in range(4)))
    out = F.when(kind == "card", card).when(kind == "ip", ip)
    for script, (syllables, endings) in SYLLABLES.items():
        for role, tails in endings.items():
            parts = [_pick(syllables, byte(F.lit(n))) for n in range(2 if turn < 2 else 3)]
            mine = kind == f"name-{script}-x" if role == "x" else (kind == f"name-{script}-g") & (gender == role)
            out = out.when(mine, F.concat(*parts, _pick(tails, byte(F.lit(5)))))
    out = out.otherwise(signs)
    return out if turn < LATE_ROUND else F.concat(out, F.when(kind == "ip", F.lit(".")).otherwise(""), F.substr(F.sha2(norm, 256), F.lit(1), F.lit(8 + 4 * (turn - LATE_ROUND))))


@functools.cache
def _drawn_key(application: str) -> str:
    return secrets.token_hex(32)


def _key(spark: SparkSession, key: str | None) -> str:
    return key or spark.conf.get(KEY_OPTION, None) or _drawn_key(spark.sparkContext.applicationId)


def surrogate_table(entities: DataFrame, key: str | None = None) -> DataFrame:
    """kind, scope, norm, surrogate of distinct entities (kind, scope, norm, shape; gender where known). No two of a kind and scope share a surrogate, and none is an entity's shape."""
    spark = entities.sparkSession
    key, tasks = _key(spark, key), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    todo, done = entities if "gender" in entities.columns else entities.withColumn("gender", F.lit("n")), None
    real = entities.select("kind", "scope", F.col("shape").alias("surrogate")).distinct()
    turn = 0
    while True:
        # Few rows that cost much each: dealt to many tasks and computed once.
        drawn = _surrogate(F.col("kind"), F.col("norm"), F.col("shape"), F.col("gender"), turn, key)
        new = materialize(todo.repartition(tasks, "kind", "norm").withColumn("surrogate", drawn), "drawn")
        first = new.groupBy("kind", "scope", "surrogate").agg(F.min("norm").alias("keeper")).join(real, ["kind", "scope", "surrogate"], "left_anti")
        if done is not None:
            first = first.join(done.select("kind", "scope", "surrogate"), ["kind", "scope", "surrogate"], "left_anti")
        tried = materialize(new.join(first, ["kind", "scope", "surrogate"], "left"), "surrogates")
        ok = tried.where("norm = keeper").select("kind", "scope", "norm", "surrogate")
        done = ok if done is None else done.unionByName(ok)
        todo = tried.where("keeper is null or norm <> keeper").select("kind", "scope", "norm", "shape", "gender")
        if not todo.limit(1).count():
            return done
        turn += 1


def _written(kind: Column, core: Column, surrogate: Column) -> Column:
    """The surrogate with the case and punctuation of the mention."""
    body = F.when(kind == "domain", F.regexp_extract(core, r"^(.*)\.[^.]*$", 1)).otherwise(core)
    gaps, shown = F.split(body, r"[\p{L}\p{N}]", -1), F.regexp_extract_all(body, F.lit(r"[\p{L}\p{N}]"), F.lit(0))
    signs = F.filter(F.split(surrogate, ""), lambda c: c != "")

    def step(x: Column) -> Column:
        c, s = x["c"], F.coalesce(x["s"], F.lit(""))
        return F.concat(F.coalesce(x["gap"], F.lit("")), F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(s)).otherwise(s))

    walked = F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), shown.alias("c"), signs.alias("s")), step), "")
    top = F.when(kind == "domain", F.concat(F.lit("."), F.regexp_extract(core, r"[^.]*$", 0))).otherwise("")
    lead = F.regexp_extract(core, r"^(?:\p{Lu}['’]|Mc(?=\p{Lu}))", 0)
    cased = F.when((core == F.upper(core)) & (F.length(core) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    no_card = (kind == "card") & (F.length(_alnum(core)) != 16) & ~F.call_function("luhn_check", _alnum(core))
    return F.when(no_card, core).when(kind == "ip", surrogate).when(kind.startswith("name-"), F.concat(lead, cased)).otherwise(F.concat(walked, top))


def _with_bare(found: DataFrame) -> DataFrame:
    """found's mentions as (mention, bare); in rows with a name, capitalised words between mentions are listed as bare, and the parts are those between all."""
    empty = F.array().cast("array<struct<mention: string, bare: boolean>>")
    parts, hits = F.col("__pii_parts"), F.col("__pii")
    named = F.exists(hits, lambda x: x.rlike(rf"\A(?:{PATTERNS['name']})\z"))

    def one(x: Column) -> Column:
        bare = F.transform(F.regexp_extract_all(x["p"], F.lit(BARE), F.lit(0)), lambda w: F.struct(w.alias("mention"), F.lit(True).alias("bare")))
        return F.concat(bare, F.when(x["m"].isNull(), empty).otherwise(F.array(F.struct(x["m"].alias("mention"), F.lit(False).alias("bare")))))

    both = F.flatten(F.transform(F.arrays_zip(parts.alias("p"), hits.alias("m")), one))
    plain = F.transform(hits, lambda x: F.struct(x.alias("mention"), F.lit(False).alias("bare")))
    found = found.withColumn("__pii_named", named)
    cut = F.when(F.col("__pii_named"), F.flatten(F.transform(parts, lambda p: F.split(p, BARE, -1)))).otherwise(parts)
    return found.withColumns({"__pii_parts": cut, "__pii": F.when(F.col("__pii_named"), both).otherwise(plain)}).drop("__pii_named")


def _later(bare: DataFrame, mentions: DataFrame) -> DataFrame:
    """Bare words (__pii_row, at, core, norm) with the kind of the name they mention in their row, else null."""
    name = mentions.where(F.col("kind").startswith("name-") & (F.length("norm") > 1) & ~F.col("norm").rlike(rf"^(?:{_PARTICLES})$"))
    name = name.groupBy("__pii_row", "norm").agg(F.max("kind").alias("kind"))  # x, a surname, is the last letter of all
    return bare.select("__pii_row", "at", F.col("mention").alias("core"), F.lower("mention").alias("norm")).join(name, ["__pii_row", "norm"], "left")


def replace(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs' columns with surrogates in text, then n_entities (mentions found); a column of docs with that name is left out."""
    docs, key = docs.drop("n_entities"), _key(docs.sparkSession, key)
    cols = docs.columns
    text = F.col("text")
    hits = F.when(F.coalesce(text.rlike(HINT), F.lit(False)), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    searched = docs.withColumn("__pii", F.coalesce(hits, F.array().cast("array<string>"))).withColumn("__pii_parts", F.when(F.size("__pii") > 0, F.split(text, ANY, -1)))
    searched = materialize(searched.withColumn("__pii_row", F.monotonically_increasing_id()), "searched")
    clean = searched.where("size(__pii) = 0").select(*cols).withColumn("n_entities", F.lit(0))
    found = materialize(_with_bare(searched.where("size(__pii) > 0")), "found")
    listed = found.select("__pii_row", F.posexplode("__pii").alias("at", "x")).select("__pii_row", "at", "x.*")
    m = listed.where("not bare").select("__pii_row", "at", "mention").withColumn("kind", kind_of(F.col("mention")))
    lead = F.when(F.col("kind") == "secret", F.regexp_extract("mention", r"^[^=:]*[=:]\s*[\"']?", 0)).when(F.col("kind") == "idno", F.regexp_extract("mention", r"^(.*?)[A-Z]{0,3}\d{6,12}[A-Z]?$", 1)).when(F.col("kind") == "name", F.regexp_extract("mention", f"^{_LEAD}", 0)).otherwise("")
    m = m.withColumn("lead", lead).withColumn("core", F.substr("mention", F.length("lead") + 1, F.length("mention")))
    title = F.regexp_replace(F.trim("lead"), r"\.", "")
    m = m.withColumn("gender", F.when(title.rlike(f"^(?:{_MALE})$"), "m").when(title.rlike(f"^(?:{_FEMALE})$"), "f"))
    m = m.select("__pii_row", "at", "lead", "kind", "gender", F.posexplode(_entities(F.col("kind"), F.col("core"))).alias("nth", "e")).select("__pii_row", "at", "lead", "gender", F.col("kind").alias("as"), "nth", "e.*")
    m = materialize(m, "mentions")
    later = materialize(_later(listed.where("bare"), m), "later")
    one_gender = F.when(F.min("gender") == F.max("gender"), F.min("gender")).otherwise("n")
    known = surrogate_table(m.groupBy("kind", "scope", "norm").agg(F.min("shape").alias("shape"), one_gender.alias("gender")), key)
    again = later.where("kind is not null").select("__pii_row", "at", F.lit("").alias("lead"), F.lit("name").alias("as"), F.lit(0).alias("nth"), "kind", F.lit("").alias("scope"), "norm", F.col("norm").alias("shape"), "core", F.lit("").alias("before"))
    shown = m.drop("gender").unionByName(again).join(known, ["kind", "scope", "norm"]).select("__pii_row", "at", "lead", "as", "nth", F.concat("before", _written(F.col("kind"), F.col("core"), F.col("surrogate"))).alias("s"))
    parts = shown.groupBy("__pii_row", "at").agg(F.min("lead").alias("lead"), F.min("as").alias("as"), F.array_sort(F.collect_list(F.struct("nth", "s"))).alias("parts"))
    sep = F.when(F.col("as") == "email", "@").otherwise("")
    whole = parts.select("__pii_row", F.struct("at", F.concat("lead", F.reduce(F.col("parts.s"), F.lit(None).cast("string"), lambda a, s: F.when(a.isNull(), s).otherwise(F.concat(a, sep, s)))).alias("s")).alias("part"), F.lit(1).alias("new"))
    whole = whole.unionByName(later.where("kind is null").select("__pii_row", F.struct("at", F.col("core").alias("s")).alias("part"), F.lit(0).alias("new")))
    per_row = whole.groupBy("__pii_row").agg(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["s"]).alias("__pii_new"), F.sum("new").cast("int").alias("__pii_n"))
    rebuilt = F.array_join(F.transform("__pii_parts", lambda p, i: F.concat(p, F.coalesce(F.get("__pii_new", i), F.lit("")))), "")
    changed = found.join(per_row, "__pii_row").withColumn("text", rebuilt).withColumn("n_entities", F.col("__pii_n"))
    return clean.unionByName(changed.select(*cols, "n_entities"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
