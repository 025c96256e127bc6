"""Personal data replaced by keyed surrogates, in DataFrame expressions only.

One pattern finds mail addresses, IP addresses, telephone numbers, payment cards, social security numbers, IBANs and
names after a title. An entity's surrogate depends on a key, its kind and its normal form, so all mentions of it get
the same surrogate whatever their spelling (coreference), written in the form of the mention: digits stay digits,
letters stay letters of their case, signs stay. Cards with a valid check digit get one, IP addresses stay valid and
private ones private, names keep the gender of their title and their script.

Numbers and addresses of one form are a closed space: their surrogates are a keyed permutation of it, so they are
distinct by construction, however full the space is. Names and mails are open: names are drawn from parts, and every
further draw makes them and the local parts of mails longer. A pass over the distinct entities of all documents checks that no two
share a surrogate and that none is another real entity. Those that do are drawn again, round by round; only these
exceptions are joined back. Numbers that still meet real ones after CLOSED_ROUNDS, as they must where real ones fill
more than half of a space, keep their first surrogate: it is a real entity's form, but no other entity has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.tables import saved

KINDS = ("email", "ip", "phone", "card", "ssn", "iban", "name")
#: Kinds whose surrogates are a permutation of all entities of the same form.
CLOSED = ("ip", "phone", "card", "ssn", "iban")
#: Draws after the first that an entity of a closed kind gets to evade real ones, and that any gets before it is an error.
CLOSED_ROUNDS, ROUNDS = 6, 20
#: Bytes of exceptions up to which they are broadcast; more are joined by a shuffle.
BROADCAST = 32 << 20

_OCTET = "(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)"
_TITLE = "(?:Mr|Mrs|Ms|Miss|Mister|Sir|Madam|Herrn?|Frau|M|Mme|Monsieur|Madame|Mlle|Sr|Sra|Srta|Señor|Señora|Señorita|Don|Doña|Господин|Госпожа|Κύριος|Κυρία)"
_FEMALE = "^(?:Mrs|Ms|Miss|Madam|Frau|Mme|Madame|Mlle|Sra|Srta|Señora|Señorita|Doña|Госпожа|Κυρία)\\b"
_CAPITAL = "\\p{Lu}[\\p{Ll}]+(?:[-'’]\\p{Lu}[\\p{Ll}]+)?"
#: Letters that words are written with side by side: before other signs of a mail address they are the sentence, alone they are its local part.
_UNSPACED = "\\u0e00-\\u0eff\\u1000-\\u109f\\u1100-\\u11ff\\u1780-\\u17ff\\u3005-\\u30ff\\u3130-\\u318f\\u3400-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff\\x{20000}-\\x{3ffff}"
_SPACED = f"[\\p{{L}}\\p{{M}}&&[^\\x00-\\x7f{_UNSPACED}]]"
_ALONE = f"[\\p{{L}}\\p{{M}}&&[{_UNSPACED}]]"
_LOCAL = f"(?<![A-Za-z0-9._%+-])(?<!{_SPACED})(?:[A-Za-z0-9._%+-]++|{_SPACED}++)++"
_DOMAIN = "@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,250}[A-Za-z0-9])?\\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
#: Alternatives in this order; a mention is the leftmost match. Possessive runs keep the matching linear.
PATTERNS = (
    ("email", f"{_LOCAL}{_DOMAIN}"),
    ("ip", f"(?<![\\d.])(?:{_OCTET}\\.){{3}}{_OCTET}(?!\\d|\\.\\d)"),
    ("iban", "(?<![A-Za-z0-9])[A-Z]{2}\\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])"),
    ("phone", "(?<![\\w+])\\+\\d{1,3}[ .-]?(?:\\(\\d{1,5}\\)[ .-]?)?\\d{2,5}(?:[ .-]?\\d{2,5}){1,4}(?!\\d)|(?<![\\w(])\\(\\d{3}\\) ?\\d{3}-\\d{4}(?!\\d)|(?<![\\d-])\\d{3}-\\d{3}-\\d{4}(?![\\d-])"),
    ("card", "(?<![\\w.-])[3-6]\\d{3}(?:[ -]\\d{4}){3}(?![\\w-])|(?<![\\w.-])[3-6]\\d{12,18}(?![\\w-])"),
    ("ssn", "(?<![\\d-])\\d{3}-\\d{2}-\\d{4}(?![\\d-])"),
    ("name", f"(?<![\\p{{L}}\\p{{N}}]){_TITLE}\\.? {_CAPITAL}(?: {_CAPITAL}){{0,2}}"),
)
#: What every alternative of a group demands is looked at once for them: letters and mails never start after an ASCII letter
#: or digit, numbers start with a digit or one of two signs. Only mails can start where numbers do; they come first, as above.
_NUMBERS = ("ip", "phone", "card", "ssn")
PATTERN = "|".join(
    f"{common}(?:" + "|".join(f"(?:{p})" for kind, p in PATTERNS if (kind in _NUMBERS) == numbers) + ")"
    for common, numbers in (("(?<![A-Za-z0-9])", False), ("(?=[0-9+(])", True))
) + f"|(?=[{_UNSPACED}])(?<!{_ALONE}){_ALONE}++{_DOMAIN}"

#: Given names by script and gender, and parts that family names are made of.
GIVEN = {
    ("latin", "m"): "Adam Albert Anton Arthur Bruno Carl Conrad Daniel David Edgar Emil Erik Felix Frank Hugo Ivan Jan Julian Karl Leo Louis Lucas Marc Martin Max Oscar Paul Peter Robert Roman Samuel Simon Stefan Theo Thomas Victor".split(),
    ("latin", "f"): "Ada Alba Alice Anna Bianca Carla Clara Diana Dora Elena Ella Emma Erika Eva Flora Gloria Helena Ida Irene Jana Julia Klara Laura Lea Linda Lucia Maria Marta Mia Nina Nora Olga Paula Rosa Sara Sofia".split(),
    ("cyrillic", "m"): "Алексей Андрей Антон Борис Виктор Глеб Денис Егор Иван Игорь Кирилл Лев Максим Олег Павел Роман Сергей Фёдор".split(),
    ("cyrillic", "f"): "Алла Анна Вера Галина Дарья Елена Зоя Инна Ирина Лариса Мария Нина Ольга Полина Раиса Софья Тамара Юлия".split(),
    ("greek", "m"): "Αλέξης Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Λεωνίδας Μάρκος Νίκος Πέτρος Στέφανος Φίλιππος".split(),
    ("greek", "f"): "Αγγελική Άννα Βασιλική Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νεφέλη Σοφία Χριστίνα Δάφνη".split(),
}
PARTS = {
    "latin": "bar ben cor dal den fal gar hol kas lan lor mar mel nor pal ran ros sal tor val ver wal win zan".split(),
    "cyrillic": "бар бел вол гор дан зар кал лев мар нов пан рос сав тор фад хол".split(),
    "greek": "βαρ γαλ δαν ζαρ καλ λαμ μαρ νικ παπ ραλ σαβ ταρ φαν χαλ".split(),
}


def kind_of(mention: Column) -> Column:
    """The kind of a whole match of PATTERN, by its shape alone."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(f"^(?:{_OCTET}\\.){{3}}{_OCTET}$"), "ip")
        .when(mention.rlike("^[A-Z]{2}\\d{2}"), "iban")
        .when(mention.rlike("^\\d{3}-\\d{2}-\\d{4}$"), "ssn")
        .when(mention.rlike("^[3-6]") & (F.length(digits) >= 13), "card")
        .when(mention.rlike("^[+(\\d]"), "phone")
        .otherwise("name")
    )


def normal(mention: Column, kind: Column) -> Column:
    """One spelling for all mentions of an entity. Names lose their title but not the gender that it gives."""
    female = F.when(mention.rlike(_FEMALE), "f:").otherwise("m:")
    return (
        F.when(kind == "name", F.concat(female, F.lower(F.regexp_replace(mention, f"^{_TITLE}\\.? ", ""))))
        .when(kind == "email", F.lower(mention))
        .when(kind == "ip", F.regexp_replace(mention, "(?<!\\d)0+(?=\\d)", ""))
        .otherwise(F.regexp_replace(mention, "[^A-Z0-9]", ""))
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, also where it is used in a lambda for each sign."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digest(key: str, kind: Column, what: Column, draw: Column) -> Column:
    """Bytes, as hexadecimal, that only who has the key can tell; at least as many as the signs of `what`."""
    seed = F.concat_ws("|", F.lit(key), kind, draw.cast("string"), what)
    blocks = F.sequence(F.lit(0), F.ceil(F.length(what) / 24).cast("int"))
    return F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat_ws("|", seed, i.cast("string"), F.lit(key)), 256)), "")


def _number(digest: Column, at: Column | int, width: int = 4) -> Column:
    """The at-th number in a digest, below 16 ** width."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(digest, (at * 2 + 1).cast("int"), F.lit(width)), 16, 10).cast("int")


def _luhn(digits: Column) -> Column:
    """The check sum of digits, 0 if they are valid."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10


def _picked(words: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), n % len(words))


def _shifted(text: Column, digest: Column, lead: bool) -> Column:
    """Each digit, small and capital letter moves on in its class by a number of the digest; other signs stay.

    With `lead` a first digit of 2 to 9 stays one, and 0 and 1 stay themselves.
    """

    def one(sign: Column, at: Column) -> Column:
        code, n = F.ascii(sign), _number(digest, at)
        moved = F.when(sign.rlike("^[0-9]$"), F.char((code - 48 + n) % 10 + 48)).when(sign.rlike("^[a-z]$"), F.char((code - 97 + n) % 26 + 97))
        moved = moved.when(sign.rlike("^[A-Z]$"), F.char((code - 65 + n) % 26 + 65)).otherwise(sign)
        if not lead:
            return moved
        return F.when(at > 0, moved).when(sign.rlike("^[2-9]$"), F.char((code - 50 + n) % 8 + 50)).otherwise(sign)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _stirred(halves: tuple[Column, Column], digest: Callable[[int, Column], Column], move: Callable[[int, Column, Column], Column], then: Callable[[Column, Column], Column], rounds: int = 4) -> Column:
    """then(left, right) after rounds in which one half moves by a digest of the other: a bijection whatever the digest is."""
    left, right = halves
    if not rounds:
        return then(left, right)
    moved = rounds % 2  # the last round moves the right half
    here, there = (right, left) if moved else (left, right)
    return _bound(
        _bound(digest(rounds, there), lambda d: move(moved, here, d)),
        lambda new: _stirred((left, new) if moved else (new, right), digest, move, then, rounds - 1),
    )


def _permuted(text: Column, key: str, kind: Column, draw: Column, lead: bool = False) -> Column:
    """A keyed permutation of the texts of one form: of that length, with digits, letters and signs where `text` has them."""
    half = F.ceil(F.length(text) / 2).cast("int")
    halves = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))

    def digest(step: int, other: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), kind, draw.cast("string"), F.lit(str(step)), other, F.length(text).cast("string"))
        blocks = F.sequence(F.lit(0), F.floor(half / 30).cast("int"))
        return F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat_ws("|", seed, i.cast("string"), F.lit(key)), 256)), "")

    return _stirred(halves, digest, lambda right, here, d: _shifted(here, d, lead and not right), F.concat)


#: First octets that stay as they are: with the next one those of private networks, alone the others.
_WIDE, _NARROW = (172, 192), (10, 127)


def _permuted_ip(what: Column, key: str, draw: Column) -> Column:
    """A keyed permutation of the addresses of a network: 10., 127., any 172.x. or 192.x., all other unicast ones, or those beyond."""
    octet = F.transform(F.split(what, "\\."), lambda o: o.cast("int"))
    first = F.get(octet, F.lit(0))
    public = (first > 0) & (first < 224) & ~first.isin(*_WIDE, *_NARROW)
    kept = sorted((*_WIDE, *_NARROW))
    index = first - 1
    for o in kept:
        index = index - F.when(first > o, 1).otherwise(0)
    halves = F.array(F.when(public, index).otherwise(first), F.get(octet, F.lit(1))), F.array(F.get(octet, F.lit(2)), F.get(octet, F.lit(3)))

    def digest(step: int, other: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), F.lit("ip"), draw.cast("string"), F.lit(str(step)), F.array_join(other, "."), F.lit(key)), 256)

    def move(right: int, here: Column, d: Column) -> Column:
        def one(o: Column, i: Column) -> Column:
            n = _number(d, i)
            if right:
                return (o + n) % 256
            return F.when(i == 0, F.when(public, (o + n) % (223 - len(kept))).otherwise(o)).when(first.isin(*_WIDE), o).otherwise((o + n) % 256)

        return F.transform(here, one)

    def then(left: Column, right: Column) -> Column:
        shown = F.get(left, F.lit(0)) + 1
        for o in kept:
            shown = shown + F.when(shown >= o, 1).otherwise(0)
        head = F.when(public, shown).otherwise(first)
        return F.concat_ws(".", *(c.cast("string") for c in (head, F.get(left, F.lit(1)), F.get(right, F.lit(0)), F.get(right, F.lit(1)))))

    return _stirred(halves, digest, move, then)


def _check(body: Column) -> Column:
    """The check digit of the digits of a card before it."""
    return (10 - _luhn(F.concat(body, F.lit("0")))) % 10


def _name(key: str, what: Column, draw: Column, digest: Column) -> Column:
    own = F.substring(what, F.lit(3), F.length(what))
    script = F.when(own.rlike("\\p{IsCyrillic}"), "cyrillic").when(own.rlike("\\p{IsGreek}"), "greek").otherwise("latin")
    gender = F.substring(what, 1, 1)
    given, family = F.lit(None), F.lit(None)
    for (s, g), words in GIVEN.items():
        given = F.when((script == s) & (gender == g), _picked(words, _number(digest, 0))).otherwise(given)
    for s, parts in PARTS.items():  # a part more with every draw
        made = F.array_join(F.transform(F.sequence(F.lit(0), (draw + 2).cast("int")), lambda i: _picked(parts, _number(digest, i * 2 + 2))), "")  # noqa: B023
        family = F.when(script == s, made).otherwise(family)
    return F.concat(gender, F.lit(":"), F.lower(F.concat_ws(" ", F.when(own.contains(" "), given), family)))


def drawn(key: str, kind: Column, what: Column, draw: Column) -> Column:
    """The surrogate of a normal form, in normal form, on a draw."""
    # Letters of the local part beyond ASCII become ASCII ones.
    local, domain = F.regexp_replace(F.substring_index(what, "@", 1), "[^\\x00-\\x7F]", "x"), F.substring_index(what, "@", -1)
    top = F.regexp_extract(domain, "(?:^|\\.)example\\.(?:com|net|org)$|\\.[a-z]+$", 0)  # reserved names stay reserved
    # A domain has one surrogate for all its addresses; only the local part is drawn again, and then it grows.
    moved = _permuted(F.substring(domain, F.lit(1), F.length(domain) - F.length(top)), key, F.lit("domain"), F.lit(0))
    longer = _bound(_digest(key, kind, what, draw), lambda d: F.substring(F.translate(d, "0123456789", "ghijklmnop"), F.lit(9), (draw + 1).cast("int")))
    email = F.concat(_permuted(local, key, F.concat_ws("@", kind, domain), draw), F.when(draw > 0, longer).otherwise(""), F.lit("@"), moved, top)
    # Country codes of one digit are 1 and 7; a number without one starts with its area.
    country = F.when(F.length(what) <= 10, 0).when(what.rlike("^[17]"), 1).otherwise(2)
    phone = F.concat(F.substring(what, F.lit(1), country), _permuted(F.substring(what, country + 1, F.length(what)), key, F.concat_ws("+", kind, F.substring(what, F.lit(1), country)), draw, lead=True))
    first, last = F.substring(what, 1, 1), F.substring(what, -1, 1).cast("int")
    off = (last - _check(F.substring(what, F.lit(1), F.length(what) - 1)) + 10) % 10  # 0 for valid cards, else what it is wrong by
    body = F.concat(first, _permuted(F.substring(what, F.lit(2), F.length(what) - 2), key, F.concat(kind, first), draw))
    card = _bound(body, lambda b: F.concat(b, ((_check(b) + off) % 10).cast("string")))
    iban = F.concat(F.substring(what, 1, 2), _permuted(F.substring(what, F.lit(3), F.length(what)), key, F.concat(kind, F.substring(what, 1, 2)), draw))
    name = _bound(_digest(key, kind, what, draw), lambda d: _name(key, what, draw, d))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", _permuted_ip(what, key, draw))
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "iban", iban)
        .when(kind == "name", name)
        .otherwise(_permuted(what, key, kind, draw))
    )


def written(mention: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate in the form of a mention: its signs between the digits, its title, its capitals."""
    return _bound(surrogate, lambda found: _written(mention, kind, found))


def _written(mention: Column, kind: Column, surrogate: Column) -> Column:
    signs = F.split(mention, "")
    taken = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), "[^A-Z0-9]", ""))
    spelled = F.array_join(F.transform(signs, lambda c, i: F.when(c.rlike("^[A-Z0-9]$"), F.substring(surrogate, taken(i) + 1, F.lit(1))).otherwise(c)), "")
    title = F.regexp_extract(mention, f"^{_TITLE}\\.? ", 0)
    case = lambda c, i: F.when(F.substring(mention, i + 1, F.lit(1)).rlike("^\\p{Lu}$"), F.upper(c)).otherwise(c)
    email = F.array_join(F.transform(F.split(surrogate, ""), case), "")
    return (
        F.when(kind == "name", F.concat(title, F.initcap(F.substring(surrogate, F.lit(3), F.length(surrogate)))))
        .when(kind == "email", email)
        .when(kind == "ip", surrogate)
        .otherwise(spelled)
    )


def exceptions(entities: DataFrame, key: str) -> DataFrame:
    """(kind, what, surrogate) for the rows of entities (kind, what) that do not keep their first surrogate.

    entities has each entity once. Of several that share a surrogate the one of the earliest draw, then the least, keeps
    it; none keeps a real entity's form, but for closed kinds after CLOSED_ROUNDS, which then have their first one, as
    nobody else can have it. Every round draws again only for those that clash, but checks against all.
    """
    given = saved(entities.withColumn("draw", F.lit(0)).withColumn("surrogate", drawn(key, F.col("kind"), F.col("what"), F.lit(0))), "entities")
    real = given.select("kind", F.col("what").alias("surrogate"), F.lit(None).cast("struct<draw:int,what:string>").alias("of"))
    changed, settled = given.limit(0), given.limit(0).select("kind", "what")
    for draw in range(1, ROUNDS):
        others = changed.select("kind", "what").unionByName(settled)
        every = given.join(others, ["kind", "what"], "left_anti").unionByName(changed) if draw > 1 else given
        owners = every.select("kind", "surrogate", F.struct("draw", "what").alias("of")).unionByName(real)
        held = owners.groupBy("kind", "surrogate").agg(F.min("of").alias("least"), F.count("of").alias("n"), (F.count("*") > F.count("of")).alias("real"))
        clashing = held.where("n > 1 OR (n > 0 AND real)")
        again = every.join(clashing, ["kind", "surrogate"]).where("real OR what <> least.what").select("kind", "what")
        again = saved(again.withColumn("draw", F.lit(draw)).withColumn("surrogate", drawn(key, F.col("kind"), F.col("what"), F.lit(draw))), "redrawn")
        if again.isEmpty():
            return changed.select("kind", "what", "surrogate")
        changed = changed.join(again.select("kind", "what"), ["kind", "what"], "left_anti")
        if draw > CLOSED_ROUNDS:
            closed = F.col("kind").isin(*CLOSED)
            settled = settled.unionByName(again.where(closed).select("kind", "what"))
            again = again.where(~closed)
        changed = saved(changed.unionByName(again), "changed")
    raise ValueError("an entity has no surrogate of its own; give another key")


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_email, n_ip, n_phone, n_card, n_ssn, n_iban, n_name for each row of docs (doc_id, text; others are ignored).

    text has every mention replaced; the counts are of mentions. Null texts stay null with counts 0, texts without
    mentions stay as they are. Equal entities get equal surrogates in all documents, distinct ones distinct surrogates,
    none of which is an entity of these documents as long as their form has room. The key is a secret of the caller:
    without it nobody can tell which surrogate belongs to whom. Repeated rows give repeated results, a null doc_id stays
    null, an empty table gives an empty one. Texts are scanned whole, in time that grows with their length; where two
    patterns match at one place the one listed first counts.
    """
    # Each mention gets a mark before and after it; the mark holds the hash of the text, so the text does not hold it.
    mark = F.concat(F.lit("\ufdd0"), F.hex(F.xxhash64("text")), F.lit("\ufdd1"))
    marked = docs.select("doc_id", "text").withColumn("mark", mark)
    marked = marked.withColumn("parts", F.split(F.regexp_replace("text", F.lit(PATTERN), F.concat("mark", F.lit("$0"), "mark")), F.col("mark"), -1))
    mentions = F.filter("parts", lambda _, i: i % 2 == 1)
    told = lambda m, kind: F.struct(m.alias("mention"), kind.alias("kind"), normal(m, kind).alias("what"))
    found = marked.withColumn("mentions", F.coalesce(F.transform(mentions, lambda m: _bound(kind_of(m), lambda kind: told(m, kind))), F.array())).drop("mark")
    some = found.where(F.size("mentions") > 0).select(F.xxhash64("text").alias("key"), F.explode("mentions").alias("m")).select("key", "m.kind", "m.what").distinct()
    some = saved(some, "mentions")
    odd = exceptions(some.select("kind", "what").distinct(), key)
    # Documents with an exception get a map of theirs; rows of equal texts, or of equal hashes, share one.
    entry = F.struct(F.concat_ws("|", "kind", "what"), "surrogate")
    size = F.length("what") + F.length("surrogate") + 64  # what an entry takes, with room for what holds it
    maps = some.join(odd, ["kind", "what"]).groupBy("key").agg(F.map_from_entries(F.collect_list(entry)).alias("odd"), F.sum(size).alias("bytes"))
    maps = saved(maps, "odd")
    n, held = maps.agg(F.count("*"), F.sum("bytes")).first()
    if n:
        side = F.broadcast(maps) if held + 64 * n <= BROADCAST else maps
        found = found.withColumn("key", F.xxhash64("text")).join(side.drop("bytes"), "key", "left").drop("key")
    else:
        found = found.withColumn("odd", F.lit(None).cast("map<string,string>"))

    def surrogate(m: Column) -> Column:
        exception = F.try_element_at(F.col("odd"), F.concat_ws("|", m["kind"], m["what"]))
        return written(m["mention"], m["kind"], F.coalesce(exception, drawn(key, m["kind"], m["what"], F.lit(0))))

    between = F.filter("parts", lambda _, i: i % 2 == 0)
    pieces = F.zip_with(between, F.transform("mentions", surrogate), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    count = lambda kind: F.size(F.filter("mentions", lambda m: m["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        F.when(F.size("mentions") > 0, F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"),
        *(count(k).alias(f"n_{k}") for k in KINDS),
    )
