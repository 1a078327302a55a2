"""Column expressions for text: tokenising, stop words, display helpers.

Everything here returns a ``Column`` so that it stays inside whole-stage
codegen; nothing runs in Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token rule: lower-case, then maximal runs of two or more word characters
# (letters, digits, underscore).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# --- fixed values -----------------------------------------------------------
# English stop-word list of the standard bag-of-words vectoriser (318 words),
# in alphabetical order. Results only match when this list is exactly this.
ENGLISH_STOP_WORDS = tuple("""
a about above across after afterwards again against all almost alone along
already also although always am among amongst amoungst amount an and another
any anyhow anyone anything anyway anywhere are around as at back be became
because become becomes becoming been before beforehand behind being below
beside besides between beyond bill both bottom but by call can cannot cant co
con could couldnt cry de describe detail do done down due during each eg eight
either eleven else elsewhere empty enough etc even ever every everyone
everything everywhere except few fifteen fifty fill find fire first five for
former formerly forty found four from front full further get give go had has
hasnt have he hence her here hereafter hereby herein hereupon hers herself him
himself his how however hundred i ie if in inc indeed interest into is it its
itself keep last latter latterly least less ltd made many may me meanwhile
might mill mine more moreover most mostly move much must my myself name namely
neither never nevertheless next nine no nobody none noone nor not nothing now
nowhere of off often on once one only onto or other others otherwise our ours
ourselves out over own part per perhaps please put rather re same see seem
seemed seeming seems serious several she should show side since sincere six
sixty so some somehow someone something sometime sometimes somewhere still
such system take ten than that the their them themselves then thence there
thereafter thereby therefore therein thereupon these they thick thin third
this those though three through throughout thru thus to together too top
toward towards twelve twenty two un under until up upon us very via was we
well were what whatever when whence whenever where whereafter whereas whereby
wherein whereupon wherever whether which while whither who whoever whole whom
whose why will with within without would yet you your yours yourself
yourselves
""".split())
# --- end fixed values -------------------------------------------------------


def tokens(text: Column | str) -> Column:
    """array<string> of lower-cased tokens, in text order, duplicates kept."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def is_stop_word(term: Column | str) -> Column:
    """Membership in the fixed list. Spark turns a long IN list into a hash-set
    lookup (InSet) that stays in generated code: no join, no Python."""
    c = F.col(term) if isinstance(term, str) else term
    return c.isin(*ENGLISH_STOP_WORDS)


def content_tokens(text: Column | str) -> Column:
    """Tokens with stop words removed (order and duplicates kept)."""
    stop = F.array(*[F.lit(w) for w in ENGLISH_STOP_WORDS])
    return F.filter(tokens(text), lambda t: ~F.array_contains(stop, t))


def stars(p: Column | str) -> Column:
    """Significance marker: *** p<0.01, ** p<0.05, * p<0.1, else ''."""
    c = F.col(p) if isinstance(p, str) else p
    return (F.when(c < 0.01, "***").when(c < 0.05, "**").when(c < 0.1, "*")
            .otherwise(""))


def ellipsize(text: Column | str, width: int = 57) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def bar(r2: Column | str, scale: int = 30) -> Column:
    """'#' repeated int(r2*scale) times; negative values give ''."""
    c = F.col(r2) if isinstance(r2, str) else r2
    return F.repeat(F.lit("#"), F.greatest(F.lit(0), (c * scale).cast("int")))


def strip_ws(c: Column) -> Column:
    """Python-style strip of surrounding whitespace (``trim`` strips spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def log_grid(start: float, stop: float, num: int) -> list[float]:
    """Values of 10**linspace(start, stop, num), largest first (path order)."""
    if num == 1:
        return [10.0 ** start]
    vals = [10.0 ** (start + (stop - start) * i / (num - 1)) for i in range(num)]
    return sorted(vals, reverse=True)
