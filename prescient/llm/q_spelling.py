"""Query of spelling variant grouping."""

from zlib import crc32

from prescient.llm.common import table
from prescient.llm.registry import query
from prescient.llm.spelling import variants, vocabulary

#: One of so many runs loses a code point.
PLANT = 199


def planted(doc_id, word):
    """``word`` without one code point if PLANT divides the crc32 of ``<doc_id>:<word>``;
    words of a row without an id stay."""
    if doc_id is None:
        return word
    h = crc32(f"{doc_id}:{word}".encode())
    if h % PLANT:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


# crc32 of bytes in DuckDB: the table of 256 numbers by eight shifts each.
_CRC = """
bits AS (SELECT 0 AS step, i AS b, i AS v FROM range(256) t(i)),
turn AS (SELECT b, list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda x, y: CASE WHEN x % 2 = 1 THEN xor(3988292384, x // 2) ELSE x // 2 END) AS v FROM bits),
tbl AS (SELECT list(v ORDER BY b) AS t FROM turn)"""

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL = rf"""
WITH {_CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOW.format("coalesce(text, '')")},
           '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS n, doc_id::VARCHAR || ':' || run AS k FROM runs
        WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, k IS NOT NULL AS known, xor(4294967295, list_reduce(list_concat([4294967295],
      flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
               ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END
               FOR c IN string_split(coalesce(k, ''), '')])),
      lambda x, y: xor(x // 256, t[(xor(x % 256, y) + 1)::INT]))) AS h
  FROM per, tbl),
altered AS (SELECT n, CASE WHEN known AND h % 199 = 0
      THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2)
      ELSE run END AS word FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM altered WHERE length(word) >= 6
      GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
        FROM w, range(1, length(word) + 1) t(i)),
pair AS (SELECT a.word AS a, b.word AS b, b.n AS n FROM cut a JOIN cut b
           ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON c.rest = w.word
         UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON c.rest = w.word),
best AS (SELECT a, count(*) AS n_near, max(n) AS top,
           min_by(b, (-n, b)) AS b FROM pair GROUP BY a),
known AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
            CASE WHEN top >= 5 * w.n THEN b END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n
          FROM w LEFT JOIN best ON best.a = w.word),
walk AS (SELECT word, word AS root, form FROM known
         UNION ALL SELECT walk.word, k.word, k.form FROM walk JOIN known k ON walk.form = k.word)
SELECT known.word, n, n_near, known.form, form_n::BIGINT AS form_n, root
FROM known JOIN walk ON walk.word = known.word AND walk.form IS NULL"""


@query("op13_spelling", _SQL.replace("WITH ", "WITH RECURSIVE ", 1))
def op13_spelling(spark, sf_dir):
    return variants(vocabulary(table(spark, sf_dir, "documents"), alter=planted))
