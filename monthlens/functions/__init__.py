from monthlens.functions.text import (  # noqa: F401
    ENGLISH_STOP_WORDS, TOKEN_PATTERN, bar, content_tokens, ellipsize, is_stop_word,
    log_grid, stars, strip_ws, tokens,
)
