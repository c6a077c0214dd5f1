"""Text functions as Column expressions: normalisation, tokens, identifiers, names, rules.

Patterns are written with explicit classes (``[\\p{L}\\p{N}_]`` for word characters) so
that they mean the same for every script, and null texts count as empty ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: White space of any script, for stripping and collapsing.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
WORD = r"[\p{L}\p{N}_]"
TOKEN = r"[\p{L}\p{N}_\-]+"

# Words that never count as memory tokens.
STOP_WORDS = [
    "и", "в", "во", "на", "по", "с", "со", "к", "о", "об", "от", "до", "за", "для",
    "что", "как", "это", "при", "не", "ни", "или", "а", "но", "же", "бы", "ли",
    "раздел", "ответ", "замечание", "необходимо", "следует", "просьба", "прошу",
    "пункт", "также", "быть", "должен", "должна", "должно", "был", "была",
]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def array_of(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), rf"^{SPACE}+", ""), rf"{SPACE}+$", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one blank, ends stripped."""
    return F.trim(F.regexp_replace(text(c), rf"{SPACE}+", " "))


def normalize_text(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text(c), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def fingerprint(c: Column | str) -> Column:
    """SHA-256 of the text with white space squeezed, in lower case."""
    return F.sha2(F.lower(squeeze(c)), 256)


def stable_id(*parts: Column | str) -> Column:
    """An id in UUID form from the SHA-1 of the parts joined by ``||``."""
    h = F.sha1(F.concat_ws("||", *[text(col(p).cast("string")) for p in parts]))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def cache_key(model: str, c: Column | str) -> Column:
    return F.sha2(F.concat(F.lit(model).cast("binary"), F.lit(b"\0"), text(c).cast("binary")), 256)


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN), 0)


def search_tokens(c: Column | str) -> Column:
    """Tokens, and each normative reference as one more token if the text has a digit."""
    codes = F.when(text(c).rlike(r"\d"), F.transform(references(c), reference_code)).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens(c), codes)


def memory_tokens(c: Column | str) -> Column:
    found = F.regexp_extract_all(F.lower(text(c)), F.lit(rf"{WORD}+"), 0)
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 4) & ~F.array_contains(array_of(*STOP_WORDS), t))))


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit(rf"{WORD}+"), 0)


def shingles(c: Column | str, k: int = 5) -> Column:
    """Distinct runs of k words; none if there are fewer words."""
    return let(words(c), lambda w: F.array_distinct(runs(w, k, lambda *x: F.concat_ws(" ", *x))))


def runs(w: Column, k: int, use, first: int = 0) -> Column:
    """``use`` of the k words of each run from place ``first`` on. Words are looked up one by one: a slice copies the whole array."""
    many = F.size(w) - k - first + 1
    every = F.transform(F.sequence(F.lit(first), first + many - 1), lambda i: use(*(F.get(w, i + j) for j in range(k))))
    return F.when(many >= 1, every).otherwise(F.array())


def is_garbled(c: Column | str, min_length: int = 80) -> Column:
    """Whether a text layer is broken: glyph ids, or many extended Latin letters beside few Cyrillic ones."""
    t = strip(text(c))
    extended, cyrillic = F.regexp_count(t, F.lit("[ƀ-ɏʰ-˿]")), F.regexp_count(t, F.lit("[а-яА-ЯёЁ]"))
    letters = F.greatest(F.regexp_count(t, F.lit(r"[\p{L}]")), F.lit(1))
    mojibake = (extended.cast("double") / letters > 0.08) & (extended > cyrillic * 0.5)
    return (F.length(t) >= min_length) & ((F.regexp_count(t, F.lit(r"\(cid:")) >= 3) | mojibake)


def slug(c: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(strip(text(c)), r'[<>:"/\\|?*]+', "_"), rf"{SPACE}+", "_")
    return F.coalesce(F.nullif(F.left(s, F.lit(120)), F.lit("")), F.lit("project"))


def snippet(c: Column | str, anchor: Column | str, width: int) -> Column:
    """``width`` characters, a third of them before the anchor, with ellipses where text is cut off; from the start if the anchor is absent."""
    t, at = text(c), F.greatest(F.instr(text(c), col(anchor)) - 1, F.lit(0))
    start = F.greatest(F.lit(0), at - F.lit(width // 3))
    end = F.least(F.length(t), start + width)
    part = F.substring(t, start + 1, end - start)
    return F.when(F.length(t) <= width, t).otherwise(F.concat(F.when(start > 0, "…").otherwise(""), part, F.when(end < F.length(t), "…").otherwise("")))


def page_number(c: Column | str) -> Column:
    """The first number in a place's name; null without one."""
    return F.regexp_extract(text(c), r"\d+", 0).try_cast("int")


# Kinds of normative documents.
REFERENCE = rf"(?iu)(СП|СНиП|ГОСТ(?:\s?Р)?|СанПиН|ГН|МУ|МР|РД|ВСН|ОНД|приказ{WORD}*\s+минприроды{WORD}*\s+росси{WORD}*|постановлени{WORD}*\s+правительства{WORD}*\s+рф|ПП\s*РФ)[\s\-–]*(№?\s?\d[\d.\-/А-Яа-я]*)"


# The same, tried only where a first letter stands: most places are left at once.
REFERENCE_QUICK = REFERENCE.replace("(?iu)", "(?iu)(?=[сгмрвоп])", 1)


def reference_key(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(c), rf"{SPACE}+", ""), F.lit("№"), F.lit(""))


def reference_code(c: Column) -> Column:
    return F.regexp_replace(reference_key(c), r"[-/]+$", "")


def references(c: Column | str) -> Column:
    """Normative references in order, the first spelling of each."""
    found = F.transform(F.regexp_extract_all(text(c), F.lit(REFERENCE_QUICK), 0), lambda r: F.regexp_replace(squeeze(r), r"[.,;:)]+$", ""))
    first = lambda f: F.filter(f, lambda r, i: F.array_position(F.transform(f, reference_key), reference_key(r)) == i + 1)
    return let(found, first)


# Rules for a remark's category, in order.
RECALCULATE = ["перерасч", "пересчит"]
CALCULATION = ["расчёт", "расчет", "рассеиван"]
CALCULATION_VERBS = ["уточн", "выполн", "привести", "откоррект", "провести", "повтор"]
NORMS = ["гост", "санпин", "снип", "гн 2", "сп 2", "сп 5", "норматив", "методик", "приказ", "постановлен", "-фз", "фз-", "в соответствии с требованиями"]
PAPERS = ["приложить", "представить", "предоставить", "лиценз", "договор", "справк", "письмо", "протокол", "паспорт отход", "сертификат"]
DATA = ["указать", "заполнить", "внести данные", "привести данные", "добавить данные", "отсутствуют данные", "не указан", "не приведен", "не приведён", "не представлены данные"]


def has_any(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def remark_category(c: Column | str) -> Column:
    t = F.lower(text(c))
    return (
        F.when(has_any(t, RECALCULATE) | (has_any(t, CALCULATION) & has_any(t, CALCULATION_VERBS)), "Перерасчёт")
        .when(has_any(t, NORMS), "Нормативы")
        .when(has_any(t, PAPERS), "Доп. документы")
        .when(has_any(t, DATA), "Ввести данные")
        .otherwise("Правка по источникам")
    )


# Kinds of missing data and how a register names them, in order.
GAP_KINDS = [
    ("изыскания", "изыскан|иэи|игми|игди|игэи|инженерно-эколог|инженерно-геолог", "Результаты изысканий"),
    ("протоколы", "протокол|лаборатор|замер|испытан|исследован проб|анализ проб", "Протоколы измерений/испытаний"),
    ("договоры", "договор|соглашен|контракт|полигон|лиценз|специализированн организац", "Договоры и лицензии"),
    ("справки", "справк|письм|запрос|ответ .*орган|цгмс|росгидромет|роспотребнадзор|минсельхоз|лесничеств|кадастр|выписк|согласован", "Справки и согласования уполномоченных органов"),
    ("расчёты", "расчёт|расчет|перерасч|рассеиван|упрза|акустическ|шум|обоснован объём|таблиц выброс", "Расчёты и обоснования"),
]
OTHER_GAP = ("иное", "Иные данные")


def gap_kind(c: Column | str, human: bool = False) -> Column:
    t = F.lower(text(c))
    first, *others = GAP_KINDS
    out = F.when(t.rlike(first[1]), first[2 if human else 0])
    for kind in others:
        out = out.when(t.rlike(kind[1]), kind[2 if human else 0])
    return out.otherwise(OTHER_GAP[1 if human else 0])


# Confidence as models write it.
CONFIDENCE = {"высокая": "high", "средняя": "medium", "низкая": "low", "high": "high", "medium": "medium", "med": "medium", "low": "low"}


def confidence(c: Column | str, answer: Column | str) -> Column:
    """high, medium or low; anything else is low without an answer and medium with one."""
    t = F.lower(strip(text(c)))
    known = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return F.coalesce(F.get(F.array(F.try_element_at(known, t)), 0), F.when(strip(text(answer)) == "", "low").otherwise("medium"))


def split_list(c: Column | str, by: str = ";") -> Column:
    """Parts of a joined list, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text(c), by), strip), lambda x: x != "")


def whole_numbers(c: Column | str) -> Column:
    """Array of strings -> its whole numbers; brackets, blanks and dots around one are ignored."""
    return F.filter(F.transform(col(c), lambda x: F.regexp_replace(x, r"^[\[\] .]+|[\[\] .]+$", "").try_cast("int")), lambda x: x.isNotNull())


# Waste classes in Roman numerals.
ROMAN = {"1": "I", "2": "II", "3": "III", "4": "IV", "5": "V"}


def waste_class(c: Column | str) -> Column:
    found = F.upper(F.regexp_extract(text(c), r"(?i)([IVX]{1,3}|[1-5])", 1))
    known = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    return F.when(found == "", text(c)).otherwise(F.concat(F.coalesce(F.try_element_at(known, found), found), F.lit(" класс опасности")))


def anchor(c: Column | str) -> Column:
    """The number behind a word for table, section or point; null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(text(c)), r"(?:^|[^а-яёa-z])(?:табл[а-яё]*|раздел[а-яё]*|п|пункт[а-яё]*)[.\s]*№?\s*(\d+(?:\.\d+)*)", 1), r"\.+$", ""), F.lit(""))


def contains_number(hay: Column, needle: Column) -> Column:
    """Whether ``needle`` occurs in ``hay`` and neither a digit nor a dot follows."""
    return (needle != "") & F.regexp_like(hay, F.concat(F.lit(r"\Q"), needle, F.lit(r"\E(?![\d.])")))


# Words that mark versions of a file, their rank and label.
VERSION_WORDS = [
    (["исходн", "первичн", "orig", "original"], 0, "исходная"),
    (["черновик", "draft"], 1, "черновик"),
    (["корр", "корректир", "изм", "испр", "revised", "rev", "правк", "ред", "редакц"], 2, "откорректированная"),
    (["финал", "итог", "final", "актуальн", "действ"], 3, "актуальная"),
]
VERSION_NUMBER = r"^(?:v|в|изм|ред|версия|вер)(\d{1,2})$"
VERSION_NUMBER_MARKS = ["v", "в", "изм", "ред", "версия", "вер"]
VERSION_WORD = r"^(?:исходн|первичн|orig|original|корр|корректир|изм|испр|revised|rev|правк|финал|итог|final|актуальн|действ|draft|черновик|редакц|ред|версия|вер)[а-яёa-z]*$"
VERSION_GLUED = r"^(?:v|в|изм|ред|rev|версия|вер)\d{1,2}$"


def stem(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"\.[^./\\]+$", "")


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[\s_\-.]+"), lambda t: t != "")


def base_name(c: Column | str) -> Column:
    """A file's name without dates and version marks; numbers of volumes stay."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem(c), r"20\d{2}[._\-]\d{1,2}[._\-]\d{1,2}", " "), r"\d{1,2}[._\-]\d{1,2}[._\-]20\d{2}", " "), r"20\d{2}", " ")
    t = name_tokens(bare)
    after_mark = lambda i: (i > 0) & F.get(t, i - 1).rlike(VERSION_WORD)
    kept = F.filter(t, lambda x, i: ~(x.rlike(VERSION_WORD) | x.rlike(VERSION_GLUED) | (x.rlike(r"^\d{1,2}$") & F.coalesce(after_mark(i), F.lit(False)))))
    return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), F.lower(bare))


def version_word_rank(c: Column | str) -> Column:
    t = name_tokens(stem(c))
    out = F.lit(0)
    for prefixes, rank, _ in VERSION_WORDS:
        out = F.when(F.exists(t, _starts_with(prefixes)), rank).otherwise(out)
    return out


def _starts_with(prefixes: list[str]):
    return lambda x: reduce(lambda a, b: a | b, [x.startswith(y) for y in prefixes])


def version_rank(c: Column | str) -> Column:
    """Rank of a file's version: that of its words, or from 2 upward by an explicit number."""
    t = name_tokens(stem(c))
    glued = F.transform(t, lambda x: F.coalesce(F.regexp_extract(x, VERSION_NUMBER, 1).try_cast("int"), F.lit(0)))
    marks = array_of(*VERSION_NUMBER_MARKS)
    apart = F.transform(t, lambda x, i: F.when((i > 0) & F.coalesce(F.array_contains(marks, F.get(t, i - 1)), F.lit(False)) & x.rlike(r"^\d+$"), x.try_cast("int")).otherwise(0))
    explicit = F.greatest(F.coalesce(F.array_max(glued), F.lit(0)), F.coalesce(F.array_max(apart), F.lit(0)))
    word = version_word_rank(c)
    return F.when(explicit > 0, F.greatest(word, F.lit(2)) + explicit).otherwise(word)


def version_label(c: Column | str) -> Column:
    return F.get(array_of(*[label for _, _, label in VERSION_WORDS]), version_word_rank(c))


def date_in_name(c: Column | str) -> Column:
    """The first valid date in a name, as YYYY-MM-DD."""
    t = text(c)
    a = F.regexp_extract(t, r"(20\d{2}[._-]\d{2}[._-]\d{2})", 1)
    b = F.regexp_extract(t, r"(\d{2}[._-]\d{2}[._-]20\d{2})", 1)
    plain = lambda x: F.regexp_replace(x, "[._]", "-")
    return F.coalesce(F.try_to_date(plain(a), "yyyy-MM-dd"), F.try_to_date(plain(b), "dd-MM-yyyy")).cast("string")


# Signs of a version in a name, with their labels, in order.
VERSION_HINTS = [
    (r"(?iu)(^|[^\p{L}\p{N}_])корр", "корректировка"),
    (r"(?iu)(^|[^\p{L}\p{N}_])испр", "исправленная"),
    (r"(?iu)(^|[^\p{L}\p{N}_])изм", "с изменениями"),
    (r"(?iu)(^|[^\p{L}\p{N}_])(финал|final($|[^\p{L}\p{N}_]))", "финальная"),
    (r"(?iu)(^|[^\p{L}\p{N}_])(ред[\p{L}\p{N}_]*\.?\s*\d+|rev\.?\s*\d+)", "редакция"),
    (r"(?iu)(^|[^\p{L}\p{N}_])v\s*\.?\s*\d+", "версия"),
]


def version_hint(c: Column | str) -> Column:
    name = F.regexp_replace(text(c), r"[._\-]+", " ")
    return F.nullif(F.array_join(F.array_compact(F.array(*[F.when(name.rlike(p), label) for p, label in VERSION_HINTS])), ", "), F.lit(""))


# Addresses, telephone numbers, numbers with units.
EMAIL = r"[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+\.[\p{L}\p{N}_.\-]+"
PHONE = r"(?:\+7|8)[\s(]*\d{3}[)\s\-]*\d{3}[\s\-]*\d{2}[\s\-]*\d{2}"
QUANTITY = r"(?iu)(\d+[.,]?\d*)\s*(г/с|т/год|мг/м3|мг/м³|мкг/м3|дБА|дБ|ПДК|м3/сут|м³/сут|м3|м³|га|км|кВт|л/с|кг|т|%)($|[^\p{L}\p{N}_])"


def emails(c: Column | str) -> Column:
    return F.regexp_extract_all(text(c), F.lit(EMAIL), 0)


def phones(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(text(c), F.lit(PHONE), 0), squeeze)


def quantities(c: Column | str) -> Column:
    """Sorted distinct numbers with units, in lower case."""
    t = text(c)
    return F.array_sort(F.array_distinct(F.transform(F.arrays_zip(F.regexp_extract_all(t, F.lit(QUANTITY), 1).alias("n"), F.regexp_extract_all(t, F.lit(QUANTITY), 2).alias("u")), lambda q: F.lower(F.concat_ws(" ", q["n"], q["u"])))))


def final_answer(user: Column | str, model: Column | str) -> Column:
    return F.coalesce(F.nullif(strip(text(user)), F.lit("")), text(model))
