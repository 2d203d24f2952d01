"""Genre texts to classes, by the rules of this module or others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tentpole.functions.text import _text

# How letters are written out, and what stands between two genres in one field.
LETTERS = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("é", "e"), ("è", "e"), ("’", "'")]
BETWEEN = r"\s+und\s+|\s*[/|;]\s*|\.\s+"
# Texts that a keyword would lead astray, with their classes; the first that matches counts.
SPECIAL = [
    (r"hardcore techno|hardcore \(electro\)|uptempo|frenchcore|terrorcore|darkcore|happy hardcore|uk hardcore|industrial hardcore|hardcore hardstyle|gabber", ["electronic"]),
    (r"hardstyle|hardtekk|hardtek\b|tekstyle|raggatek|rawstyle|hard dance|early rave|hands up|jumpstyle|bounce", ["electronic"]),
    (r"hardcore \(metal\)", ["punk", "metal"]),
    (r"classic rock|classic metal|klassiker", ["rock"]),
    (r"^uk garage$|garage house", ["electronic"]),
    (r"black music", ["soul"]),
    (r"desert blues", ["jazzblues", "world"]),
    (r"^(horror|thriller|drama|film|filme|kurzfilme|dokumentarfilm|animationsfilm|lesung|theater|comedy|kabarett|poetry|performance|artistik|zirkus|kunst|tanz|sport|yoga|healing|percussion|show)$", ["buehne"]),
    (r"musik kabarett|kunst & kultur|kabarett", ["buehne"]),
]
# The classes in their order, each with the keywords that tell it; all that match count.
KEYWORDS = {
    "rock": r"rock|n roll|billy\b|grunge|britpop|shoegaze|gazepunk|doomgaze|kraut|stoner|psychedelic|\bpsych\b|\bgarage\b|\bsurf\b|\bindie\b|\bbeat\b|\bjam\b|\bfuzz\b|\bemo\b|hamburger schule|\btrash\b|\boldies\b|\bzappa",
    "metal": r"metal|deathcore|grind|thrash|\bdoom\b|\bsludge\b|death|black|\bdjent\b|\bviking\b|kammercore|\bslam\b|\bheavy\b",
    "punk": r"punk|hardcore|\boi!?\b|crust|core|beatdown|powerviolence|screamo|riot|\bd beat\b|\bschrammel",
    "pop": r"pop|chanson|\bcharts\b|\bndw\b|neue deutsche welle|\bmalle\b|\bpink\b|spice girls",
    "hiphop": r"hip.?hop|trip.?hop|\brap\b|rapcore|\btrap\b|\bgrime\b|beatbox|\burban\b|\bcrunk\b|\bdrill\b|freestyle|spoken word",
    "electronic": r"techno|house|trance|electro|elektro|\bedm\b|\bdance\b|eurodance|\brave\b|\bgoa\b|\bpsy|dubstep|psydub|drum ?& ?bass|\bdnb\b|\bidm\b|\bjungle\b|breakbeat|bass|minimal|ambient|downtempo|downbeat|chill|\bsynth|tronic|glitch|schranz|crossbreed|oldschool|hard groove|houese|\bdisco\b|\bclub\b|\bacid\b|moombahton|\bhitech\b|\bforest\b|\bfull ?on\b|\bbig beat\b|\bbig room\b|\bmashup\b|\bcosmic\b|amapiano",
    "reggae": r"reggae|dancehall|\bska|\bdub\b|rocksteady|\bragga\b|calypso|reggaeton|\b2 tone\b",
    "jazzblues": r"jazz|blues|blies|\bswing\b|dixie|boogie|new orleans|bebop|\bold time\b|easy listening",
    "soul": r"\bsoul\b|funk|r ?& ?b|rhythm ?& ?blues|motown|gospel",
    "folk": r"folk|singer|songwriter|liedermach|americana|bluegrass|country|celtic|\birish\b|scottish|breton|nordic|shanty|acoustic|acustic|akustik|\broots\b|\bpipes\b|\bmundart\b|\bfado\b|\bpolka\b|handpan|didgeridoo|dudelsack|fingerstyle|traditionelle musik|\btrad\b",
    "world": r"world|woldmusic|weltmusik|balkan|latin|altin|salsa|cumbia|samba|afro|afrika|africa|gypsy|klezmer|flamenco|tango|reggaeton|kuduro|bachata|rumba|zouk|kologo|chicha|turkish|tribal|brass|caribbean|brazilian|mantra|kirtan|merengue|russendisko|mbalax|global|zouglou|soukous|soca|sevdalinka|son cubano|taiko|marimba|wienerlied|wiener lied|jiddisch|wassoulou|exotica|offbeat",
    "klassik": r"klassik|klassisch|classical|a.?cap+ella|\bchor\b|\boper\b|orchester|kammermusik|neue musik|alte musik|gregorian",
    "schlager": r"schlager|volksmusik|blasmusik|marschmusik|militaermusik|volkstuemlich|boehmische|mallorca|\bmalle\b|tanzmusik|dixie|\bhumpa\b|schrammel|alpen",
    "gothic": r"\bgoth|dark ?wave|cold ?wave|\bwave\b|\bebm\b|industrial|aggrotech|neue deutsche haerte|\bndh\b|dark electro|\boccult\b|\bdrone\b|\bnoise\b|cyber",
    "mittelalter": r"mittelalter|medieval|\bpirat|wikinger|\bviking\b|\bshanty\b|\bfantasy\b",
    "buehne": r"comedy|kabarett|theater|lesung|poetry|film|kino|\bkunst\b|artistik|akrobatik|jonglage|zauberei|magie|zirkus|performance|\btanz\b|\bsport\b|\byoga\b|meditation|healing|kindermusik|kinderlieder|beatboxing|\bdrama\b|\bthriller\b|\btalk\b|trommeln|perkussion|satsang|looping|serien|sakral|medicine music|community",
    "gemischt": r"genreuebergreifend|gemischt|sonstiges|\bcover|tribute|crossover|\bparty\b|\bcharts\b|\bdiverse|experimental|avantgarde|avant\b|\bmixed\b|multi ?genre|\balternative$|^\d+(er|s)?$|neue musik|blockbuster|mash ?up|coveer|\buvm\b|querbeet|alles dabei",
}
FALLBACK = "gemischt"


def normalised(c: Column | str) -> Column:
    """Lower case, umlauts written out whether they are one character or two, punctuation as blanks."""
    v = F.lower(_text(c))
    for letter in "aou":
        v = F.replace(v, F.lit(letter + "\u0308"), F.lit(letter + "e"))
    for mark in "\u0301\u0300":
        v = F.replace(v, F.lit("e" + mark), F.lit("e"))
    for old, new in LETTERS:
        v = F.replace(v, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(F.regexp_replace(v, r"[.'`´\-_]", " "), r"(?U)\s+", " "))


def of_event(df: DataFrame, column: str, out: str = "classes") -> DataFrame:
    """Add the classes of a genre field by the rules of this module.

    Fields repeat very much, so each different text is classified once and
    joined back; the join has one row a text on one side.
    """
    texts = df.select(F.coalesce(F.col(column), F.lit("")).alias("__genre")).distinct()
    known = texts.withColumn("__classes", classes("__genre", SPECIAL, KEYWORDS, FALLBACK))
    return df.withColumn("__genre", F.coalesce(F.col(column), F.lit(""))).join(known, "__genre", "left").withColumn(out, F.col("__classes")).drop("__genre", "__classes")


def classes(c: Column | str, special: list[tuple[str, list[str]]], keywords: dict[str, str], fallback: str | None = None) -> Column:
    """Classes of a genre text, in the order of ``keywords``.

    The text is split at commas and other separators. A part takes the classes
    of the first ``special`` rule that it matches, else every class whose
    pattern it matches. ``fallback`` goes when there is another class.
    """
    parts = F.filter(F.flatten(F.transform(F.split(_text(c), ","), lambda x: F.split(normalised(x), BETWEEN))), lambda x: F.trim(x) != "")

    def of(part: Column) -> Column:
        p = F.trim(part)
        every = F.filter(F.array(*(F.when(p.rlike(f"(?U){pattern}"), F.lit(k)) for k, pattern in keywords.items())), lambda k: k.isNotNull())
        for pattern, found in reversed(special):
            every = F.when(p.rlike(f"(?U){pattern}"), F.array(*(F.lit(k) for k in found))).otherwise(every)
        return every

    hit = F.array_distinct(F.flatten(F.transform(parts, of)))
    ordered = F.filter(F.array(*(F.lit(k) for k in keywords)), lambda k: F.array_contains(hit, k))
    return ordered if fallback is None else F.when(F.size(ordered) > 1, F.array_remove(ordered, fallback)).otherwise(ordered)
