"""Operations on training corpora.  Nothing outside this folder imports it."""
