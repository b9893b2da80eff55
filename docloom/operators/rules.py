"""Extraction rules as data: what to match, how to name it, how much to trust it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One group of patterns that yields entities of one type.

    ``captures`` are (pattern, format) pairs tried in order on a match to build the entity name from
    its groups.  A match none of them fits is kept whole, or dropped if ``must_capture``.
    ``description`` is a format over the groups of the first capture; without it the description is
    the label and the name.  ``starts`` holds, per pattern, what a match begins with and
    ``needs`` literals of which every match has at least one.
    """

    rule_id: str
    entity_type: str
    relevance: float
    width: int
    patterns: tuple[str, ...]
    captures: tuple[tuple[str, str], ...] = ()
    label: str | None = None
    description: str | None = None
    languages: tuple[str, ...] = ()
    union: bool = False
    strip_prefix: str | None = None
    must_capture: bool = False
    skip_captures: tuple[str, ...] = ()
    skip_names: tuple[str, ...] = ()
    min_length: int = 1
    normalize: bool = False
    trim: bool = False
    starts: tuple[str, ...] = ()
    needs: tuple[tuple[str, ...], ...] = ()


# --------------------------------------------------------------------------------------------
# Word lists and patterns of the prose rules.
# --------------------------------------------------------------------------------------------
PERSON_NAME = r"\b[A-Z][a-z]+ ([A-Z]\.? )?[A-Z][a-z]+\b"
PERSON_TITLED = r"\b(Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.) [A-Z][a-z]+ ([A-Z][a-z]+)?\b"
ORGANIZATION_WORDS = (
    r"(Inc\.|Corp\.|Ltd\.|LLC|Company|Association|Foundation|University|Technologies|Group"
    r"|Institute|Agency|Department)"
)
ORGANIZATION_LITERALS = (
    " Inc.", " Corp.", " Ltd.", " LLC", " Company", " Association", " Foundation", " University",
    " Technologies", " Group", " Institute", " Agency", " Department",
)
TITLE_LITERALS = ("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Prof. ")
STREET_LITERALS = (" St.", " Street", " Ave", " Rd.", " Road", " Blvd.", " Boulevard", " Dr")
ORGANIZATION_WORD = r"\b[A-Z][A-Za-z0-9]* " + ORGANIZATION_WORDS + r"\b"
ORGANIZATION_NAME = r"\b([A-Z][a-z]+ ){1,3}" + ORGANIZATION_WORDS + r"\b"
ACRONYM = r"\b[A-Z]{2,}\b"
LOCATION_AFTER_PREPOSITION = r"\b(in|at|from|to) ([A-Z][a-z]+ )+([A-Z][a-z]+)?\b"
MAJOR_LOCATIONS = (
    "United States|Canada|UK|Australia|China|Japan|Russia|Germany|France|Italy|Spain|Brazil|India"
    "|Mexico|New York|London|Paris|Tokyo|Berlin|Rome|Moscow|Beijing|Los Angeles|Chicago|Toronto"
    "|Sydney|Amsterdam|Dubai"
)
LOCATION_KNOWN = r"\b(" + MAJOR_LOCATIONS + r")\b"
STREET_ADDRESS = (
    r"\b[0-9]+ [A-Z][a-z]+ (St\.|Street|Ave\.|Avenue|Rd\.|Road|Blvd\.|Boulevard|Dr\.|Drive)\b"
)
MONTHS = (
    "(January|February|March|April|May|June|July|August|September|October|November|December)"
)
DATE = (
    r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b|\b[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\b"
    r"|\b" + MONTHS + r" [0-9]{1,2},? [0-9]{4}\b|\b[0-9]{1,2} " + MONTHS + r",? [0-9]{4}\b"
)
PRODUCT = (
    r"\b[A-Z][a-z]+ (Pro|Plus|Ultra|Mini|Max|Lite|Premium|Professional|Enterprise|Ultimate|Elite"
    r"|Standard)\b|\b[A-Z][a-z]+ [0-9]+( Pro| Ultra)?\b"
)
CAPITALIZED_PRODUCT = r"\b[A-Z][a-zA-Z0-9]+(™|®|©)?\b"
LEADING_PREPOSITION = r"^(?:in|at|from|to) "

TEXT_RULES = (
    Rule("person", "person", 0.75, 30, (PERSON_NAME, PERSON_TITLED), union=True,
         starts=("[A-Z][a-z]+ [A-Z]", "[MDP]"), needs=((), TITLE_LITERALS)),
    Rule("organization", "organization", 0.70, 30, (ORGANIZATION_WORD, ORGANIZATION_NAME), union=True,
         starts=("[A-Z]", "[A-Z]"), needs=(ORGANIZATION_LITERALS, ORGANIZATION_LITERALS)),
    Rule("location", "location", 0.65, 30, (LOCATION_AFTER_PREPOSITION, LOCATION_KNOWN), union=True,
         strip_prefix=LEADING_PREPOSITION, starts=("[iaft][ntro](?:om)? [A-Z]", "[A-Z]")),
    Rule("date", "date", 0.80, 30, (DATE,), union=True, starts=("[0-9ADFJMNOS]",)),
)
PRODUCT_RULE = Rule("product", "product", 0.60, 30, (PRODUCT,), union=True, starts=("[A-Z][a-z]+ [0-9A-Z]",))
# The prose rules with products, used for plain text, CSV and the fallback.
PROSE_RULES = TEXT_RULES + (PRODUCT_RULE,)

# Text taken from paged documents: wider context, acronyms, addresses, marked products.
DOCUMENT_RULES = (
    Rule("doc_person", "person", 0.75, 50, (PERSON_NAME, PERSON_TITLED), union=True, normalize=True,
         starts=("[A-Z]", "[MDP]"), needs=((), TITLE_LITERALS)),
    Rule("doc_organization", "organization", 0.70, 50,
         (ORGANIZATION_WORD, ORGANIZATION_NAME, ACRONYM), union=True, normalize=True, min_length=2,
         starts=("[A-Z]", "[A-Z]", "[A-Z]"), needs=(ORGANIZATION_LITERALS, ORGANIZATION_LITERALS, ())),
    Rule("doc_date", "date", 0.80, 50, (DATE,), union=True, normalize=True, starts=("[0-9A-Z]",)),
    Rule("doc_location", "location", 0.65, 50, (LOCATION_KNOWN, STREET_ADDRESS), union=True, normalize=True,
         starts=("[A-Z]", "[0-9]"), needs=((), STREET_LITERALS)),
    Rule("doc_product", "product", 0.60, 50, (CAPITALIZED_PRODUCT,), union=True, normalize=True, min_length=2,
         starts=("[A-Z]",)),
)

# --------------------------------------------------------------------------------------------
# Offset rules; every match counts, word edges are the ASCII ones.
# --------------------------------------------------------------------------------------------
OFFSET_WIDTH = 20
OFFSET_RULES = (
    ("person", 0.8, r"(?<![A-Za-z0-9_])[A-Z][a-z]+ (?:[A-Z][a-z]+)(?![A-Za-z0-9_])"),
    ("organization", 0.7,
     r"(?<![A-Za-z0-9_])[A-Za-z]+ (?:Inc|Corp|LLC|Ltd|Company|Association)(?![A-Za-z0-9_])"),
    ("date", 0.9,
     r"(?<![A-Za-z0-9_])[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}(?![A-Za-z0-9_])"
     r"|(?<![A-Za-z0-9_])[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?![A-Za-z0-9_])"),
)

# --------------------------------------------------------------------------------------------
# Patterns of the code rules.  All yield the type "technology".
# --------------------------------------------------------------------------------------------
JS = ("javascript", "typescript", "js", "ts")
PYTHON = ("python", "py")
JAVA = ("java",)
C_FAMILY = ("c", "cpp", "c++")
GO = ("go",)
RUBY = ("ruby", "rb")
PHP = ("php",)
RUST = ("rust", "rs")


def _code(rule_id: str, label: str, relevance: float, patterns: tuple[str, ...],
          captures: tuple = (), **more) -> Rule:
    pairs = tuple((c, "{1}") if isinstance(c, str) else c for c in captures)
    return Rule(rule_id, "technology", relevance, more.pop("width", 100), patterns, pairs, label, **more)


CODE_RULES = (
    _code("imports", "Imported dependency", 0.85,
          (r"""import\s+[\w\s,.{}]*\s+from\s+['"][^'"]+['"]""",
           r"""import\s+['"][^'"]+['"]""",
           r"import\s+[\w.]+",
           r"""#include\s+[<"][^>"]+[>"]""",
           r"""require\s*\(['"][^'"]+['"]\)""",
           r"""require\s+['"][^'"]+['"]""",
           r"use\s+[\w:]+",
           r"from\s+[\w.]+\s+import"),
          (r"""from\s+['"]([^'"]+)['"]""",
           r"""import\s+['"]([^'"]+)['"]""",
           r"""require\s*\(['"]([^'"]+)['"]\)""",
           r"""#include\s+[<"]([^>"]+)[>"]"""),
          width=50),
    _code("functions", "Function", 0.80,
          (r"function\s+[\w]+\s*\([^)]*\)",
           r"[\w]+\s*:\s*function\s*\(",
           r"const\s+[\w]+\s*=\s*\([^)]*\)\s*=>",
           r"def\s+[\w_]+\s*\([^)]*\)",
           r"\bfunc\s+[\w]+\s*\([^)]*\)",
           r"\b(public|private|protected)?(\s+static)?\s+[\w<>\[\]]+\s+[\w]+\s*\([^)]*\)",
           r"[\w_]+\s*=\s*function\s*\(",
           r"fn\s+[\w_]+\s*\([^)]*\)"),
          (r"function\s+([\w]+)",
           r"([\w]+)\s*:\s*function",
           r"const\s+([\w]+)\s*=",
           r"def\s+([\w_]+)",
           r"func\s+([\w]+)",
           r"\s+([\w]+)\s*\(",
           r"([\w_]+)\s*=\s*function",
           r"fn\s+([\w_]+)"),
          skip_captures=("return",),
          skip_names=("if", "for", "while", "switch", "catch", "then", "else", "return")),
    _code("types", "Class/Interface/Type", 0.90,
          (r"class\s+[\w]+", r"interface\s+[\w]+", r"struct\s+[\w]+", r"enum\s+[\w]+",
           r"type\s+[\w]+\s*struct", r"trait\s+[\w]+"),
          (r"class\s+([\w]+)", r"interface\s+([\w]+)", r"struct\s+([\w]+)", r"enum\s+([\w]+)",
           r"type\s+([\w]+)\s*struct", r"trait\s+([\w]+)")),
    _code("constants", "Constant", 0.70,
          (r"const\s+[A-Z_\d]+\s*=", r"final\s+[\w]+\s+[A-Z_\d]+\s*=",
           r"static\s+final\s+[\w]+\s+[A-Z_\d]+\s*=", r"#define\s+[A-Z_\d]+",
           r"var\s+[A-Z_\d]+\s*=", r"let\s+[A-Z_\d]+\s*="),
          (r"const\s+([A-Z_\d]+)", r"final\s+[\w]+\s+([A-Z_\d]+)",
           r"static\s+final\s+[\w]+\s+([A-Z_\d]+)", r"#define\s+([A-Z_\d]+)",
           r"var\s+([A-Z_\d]+)", r"let\s+([A-Z_\d]+)")),
    _code("js_components", "React Component", 0.85,
          (r"function\s+[A-Z][\w]*\s*\([^)]*\)\s*\{", r"const\s+[A-Z][\w]*\s*=\s*\([^)]*\)\s*=>",
           r"class\s+[A-Z][\w]*\s+extends\s+React\.Component",
           r"class\s+[A-Z][\w]*\s+extends\s+Component"),
          (r"function\s+([A-Z][\w]*)", r"const\s+([A-Z][\w]*)\s*=", r"class\s+([A-Z][\w]*)\s+extends"),
          languages=JS),
    _code("js_types", "TypeScript Type", 0.85,
          (r"interface\s+[\w]+\s*\{", r"type\s+[\w]+\s*=\s*\{", r"type\s+[\w]+\s*=\s*[\w]+",
           r"enum\s+[\w]+\s*\{"),
          (r"interface\s+([\w]+)", r"type\s+([\w]+)\s*=", r"enum\s+([\w]+)"),
          languages=JS),
    _code("js_hooks", "React Hook", 0.75,
          (r"use[A-Z][\w]*\(", r"const\s+\[[\w]+,\s*set[A-Z][\w]*\]\s*=\s*useState"),
          (r"(use[A-Z][\w]*)\(", (r"set([A-Z][\w]*)\]", "useState ({1})")), languages=JS),
    _code("py_decorators", "Python Decorator", 0.75, (r"@[\w_.]+",), languages=PYTHON),
    _code("py_methods", "Class Method", 0.80, (r"\s+def\s+[\w_]+\s*\(self",), (r"def\s+([\w_]+)",),
          must_capture=True, languages=PYTHON),
    _code("py_data_science", "Data Science Library", 0.90,
          (r"import\s+(numpy|pandas|matplotlib|scipy|sklearn|keras|tensorflow|torch|seaborn)",),
          (r"import\s+([\w.]+)",), must_capture=True, languages=PYTHON),
    _code("py_return_types", "Return Type", 0.70, (r"\)\s*->\s*[\w\[\],\s.]+:",),
          (r"\)\s*->\s*([\w\[\],\s.]+):",), must_capture=True, trim=True, languages=PYTHON),
    _code("java_annotations", "Java Annotation", 0.80, (r"@[A-Z][\w]+",), languages=JAVA),
    _code("java_packages", "Java Package", 0.85, (r"package\s+[\w.]+;",), (r"package\s+([\w.]+);",),
          must_capture=True, languages=JAVA),
    _code("java_interfaces", "Java Interface", 0.85,
          (r"(public|private|protected)?\s+interface\s+[\w]+",), (r"interface\s+([\w]+)",),
          must_capture=True, languages=JAVA),
    _code("java_generics", "Generic Type Parameter", 0.70,
          (r"<[A-Z]((,\s*[A-Z])*(\s+extends\s+[\w.]+)?)>",), languages=JAVA),
    _code("c_preprocessor", "Preprocessor Directive", 0.75,
          (r"#(include|define|ifdef|ifndef|endif|pragma)",), languages=C_FAMILY),
    _code("c_structs", "Struct", 0.85, (r"struct\s+[\w]+\s*\{",), (r"struct\s+([\w]+)",),
          must_capture=True, languages=C_FAMILY),
    _code("cpp_namespaces", "Namespace", 0.85, (r"namespace\s+[\w]+\s*\{",), (r"namespace\s+([\w]+)",),
          must_capture=True, languages=C_FAMILY),
    _code("cpp_templates", "Template", 0.80, (r"template\s*<[^>]+>",), languages=C_FAMILY),
    _code("go_packages", "Go Package", 0.90, (r"package\s+[\w]+",), (r"package\s+([\w]+)",),
          must_capture=True, languages=GO),
    _code("go_structs", "Go Struct", 0.85, (r"type\s+[\w]+\s+struct\s*\{",), (r"type\s+([\w]+)\s+struct",),
          must_capture=True, languages=GO),
    _code("go_interfaces", "Go Interface", 0.85, (r"type\s+[\w]+\s+interface\s*\{",),
          (r"type\s+([\w]+)\s+interface",), must_capture=True, languages=GO),
    _code("go_methods", "Method", 0.80, (r"func\s*\([\w\s\*]+\s+[\w]+\)\s+[\w]+",),
          ((r"func\s*\([\w\s\*]+\s+([\w]+)\)\s+([\w]+)", "{1}.{2}"),),
          must_capture=True, description="Method: {2} on {1}", languages=GO),
    _code("ruby_modules", "Ruby Module", 0.90, (r"module\s+[A-Z][\w:]*",), (r"module\s+([A-Z][\w:]*)",),
          must_capture=True, languages=RUBY),
    _code("ruby_symbols", "Ruby Symbol", 0.70, (r":[\w_]+",), languages=RUBY),
    _code("rails_macros", "Rails Pattern", 0.85,
          (r"has_many\s+:[\w_]+", r"belongs_to\s+:[\w_]+", r"validates\s+:[\w_]+",
           r"before_action\s+:[\w_]+", r"scope\s+:[\w_]+"), languages=RUBY),
    _code("php_namespaces", "PHP Namespace", 0.90, (r"namespace\s+[\w\\]+;",), (r"namespace\s+([\w\\]+);",),
          must_capture=True, languages=PHP),
    _code("php_methods", "Method", 0.80, (r"(public|private|protected)\s+function\s+[\w_]+\s*\(",),
          ((r"(public|private|protected)\s+function\s+([\w_]+)", "{2}"),),
          must_capture=True, description="{1} Method: {2}", languages=PHP),
    _code("php_traits", "PHP Trait", 0.85, (r"trait\s+[\w_]+",), (r"trait\s+([\w_]+)",),
          must_capture=True, languages=PHP),
    _code("rust_structs", "Rust Struct", 0.85, (r"struct\s+[\w_]+",), (r"struct\s+([\w_]+)",),
          must_capture=True, languages=RUST),
    _code("rust_enums", "Rust Enum", 0.85, (r"enum\s+[\w_]+",), (r"enum\s+([\w_]+)",),
          must_capture=True, languages=RUST),
    _code("rust_traits", "Rust Trait", 0.90, (r"trait\s+[\w_]+",), (r"trait\s+([\w_]+)",),
          must_capture=True, languages=RUST),
    _code("rust_impls", "Rust Implementation", 0.80, (r"impl(\s+[\w<>,\s]+)?\s+for\s+[\w<>,\s]+",),
          languages=RUST),
    _code("rust_macros", "Rust Macro", 0.75, (r"\w+!\(",), ((r"([\w]+)!", "{1}!"),),
          must_capture=True, languages=RUST),
)
CODE_RULES_BY_ID = {rule.rule_id: rule for rule in CODE_RULES}
