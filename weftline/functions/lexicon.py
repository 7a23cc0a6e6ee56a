"""Fixed values that results depend on: stopwords, relation verbs, phrase connectors and character classes."""

# English words that carry no content.
STOPWORDS = tuple(
    """
    a about above after again against all also am an and any are aren't as at be because been before being below between
    both but by can cannot could couldn't did didn't do does doesn't doing don't down during each few for from further
    had hadn't has hasn't have haven't having he her here hers herself him himself his how however i if in into is isn't
    it its itself just me more most must mustn't my myself no nor not of off on once only or other ought our ours
    ourselves out over own same shan't she should shouldn't so some such than that the their theirs them themselves then
    there these they this those through to too under until up upon very was wasn't we were weren't what when where which
    while who whom why with won't would wouldn't you your yours yourself yourselves
    """.split()
)

# Relation types, each with the verb forms that signal it.
RELATIONS = {
    "is_a": "is are was were",
    "uses": "use uses used using",
    "enables": "enable enables allow allows",
    "requires": "require requires",
    "contains": "contains include includes",
    "produces": "produce produces",
    "trains": "train trains",
    "supports": "support supports",
    "extends": "extends",
    "improves": "improves",
    "powers": "powers",
    "builds": "builds",
    "processes": "process processes",
    "analyzes": "analyzes analyses",
    "learns_from": "learn learns",
    "part_of": "belongs part subset",
    "links_to": "link links linked linking",
    "connects": "connect connects",
    "combines": "combine combines",
    "converts": "convert converts",
    "generates": "generate generates",
    "represents": "represent represents",
    "describes": "describe describes",
    "transforms": "transform transforms",
    "depends_on": "depend depends",
    "related_to": "relate relates",
}
VERBS = {verb: kind for kind, verbs in RELATIONS.items() for verb in verbs.split()}
UNTYPED = "co_occurs"

# Lower-case words allowed inside a proper-noun phrase.
CONNECTORS = frozenset("of de and the for von van la".split())

# Code points of scripts written without spaces (kana, CJK ideographs), tokenised one by one.
CJK_RANGES = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
CJK = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES)

# What may stand between two words of one name.
JOINTS = (" ", "-", " - ")
#: A word of any script with inner apostrophes and hyphens, or what stands between two words; RE2 reads it too.
WORD_OR_GAP = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*|[^\p{L}\p{N}]+"
CAPITAL = r"^\p{Lu}"
LAST_CONNECTORS = rf"(?i)(?:(?:^| )(?:{'|'.join(sorted(CONNECTORS))}))+$"
FIRST_CONNECTORS = r"^(?:[^\p{Lu} ][^ ]* )+"

#: Letter or digit of any script but those, for Java's regular expressions, which intersect classes; and for RE2's.
LETTER = rf"[\p{{L}}\p{{N}}&&[^{CJK}]]"
LETTER_RE2 = rf"(?:[^\P{{L}}{CJK}]|[^\P{{N}}{CJK}])"
#: What Python calls white space.
SPACE = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
SPACE_RE2 = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\p{Z}]"
APOSTROPHES = "'’"
#: What the pattern below finds in lower-case ASCII, where classes of Unicode are not needed.
ASCII_TOKEN = "[a-z0-9]+(?:['-][a-z0-9]+)*"


def token_pattern(letter: str) -> str:
    return rf"[{CJK}]|{letter}+(?:[{APOSTROPHES}-]{letter}+)*"


def elision_pattern(letter: str) -> str:
    """A prefix of one or two letters before an apostrophe, as in l'eau; don't has a short end instead."""
    return rf"^({letter}{{1,2}})[{APOSTROPHES}]({letter}.*)$"
