"""Queries of the HTML view over documents made of the test tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import html_view as H

from .packages import _t, query


def _documents(spark, sf_dir):
    """A document a part: headings of one name, marks of doubt, links of every kind, a list, a quotation, a fence, tables and sheets, some hidden."""
    size, name = F.col("p_size"), F.col("p_name")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    wide = F.array_join(F.transform(F.sequence(F.lit(1), size % 3 + 8), lambda i: F.concat(F.lit("c"), i)), " | ")
    rule = F.repeat(F.lit("---|"), size % 3 + 8)
    body = text(
        "# ", name, "\n\nA **bold** <b> & [verificar ", size, "] in `x < y`\n2 * 3\n## ", name, " ##\n- one\n  more\n- [go](https://e.org/__a__) and ![p](img/", size % 4, ".png)\n\n> quoted\n> [up](../", size, ")\n\n```\n# ", name, "\n```\n| ", wide, " |\n|", rule, "\n| v | ", size,
        " |\n\n## Hoja: S", size, F.when(size % 2 == 0, " *(oculta)*").otherwise(""), "\nfilas 2 · columnas con dato 3 · 0\n\n[ilegible]\n### ", name, "\n## Hoja: S", size, "\n1) last",
    )
    assets = F.array(F.lit("img/1.png"), F.lit("img/2.png"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), name.alias("title"), body.alias("text"), assets.alias("assets"))


@query(r"""
WITH p AS (SELECT p_partkey AS doc_id, p_name AS name, replace(p_name, ' ', '-') AS slug, p_size AS s, p_size % 3 + 8 AS w, p_size % 2 = 0 AS hidden, chr(10) AS nl FROM part),
t AS (
  SELECT *, w > 9 AS wide, list_transform(range(1, w + 1), lambda i: CASE WHEN i > 2 THEN ' cv' ELSE '' END) AS hollow FROM p)
SELECT doc_id, 2::bigint AS sheets, 1::bigint AS tables, 2::bigint AS marks,
  '<h1 id="' || slug || '">' || name || '</h1>' || nl || '<p>A <strong>bold</strong> &lt;b&gt; &amp; <mark class="verificar" id="m1">[verificar ' || s || ']</mark> in <code>x &lt; y</code> 2 * 3</p>' || nl
  || '<h2 id="' || slug || '-2">' || name || '</h2>' || nl || '<ul><li>one more</li><li><a href="https://e.org/__a__" rel="noopener noreferrer" target="_blank">go</a> and '
  || CASE WHEN s % 4 IN (1, 2) THEN '<img src="img/' || s % 4 || '.png" alt="p" loading="lazy">' ELSE '<span class="falta">imagen ausente: img/' || s % 4 || '.png</span>' END || '</li></ul>' || nl
  || '<blockquote>' || nl || '<p>quoted <a href="../' || s || '">up</a></p>' || nl || '</blockquote>' || nl || '<pre><code># ' || name || '</code></pre>' || nl
  || '<div class="tabla' || CASE WHEN wide THEN ' ancha"><div class="tabla-meta">1 filas × ' || w || ' columnas · ' || round(100.0 * (w - 2) / w)::int || ' % vacías</div>' ELSE '">' END
  || '<table><thead><tr>' || array_to_string(list_transform(range(1, w + 1), lambda i: '<th scope="col"' || CASE WHEN i > 2 THEN ' class="cv"' ELSE '' END || '>c' || i || '</th>'), '') || '</tr></thead><tbody><tr>'
  || '<td' || CASE WHEN wide THEN ' title="v"' ELSE '' END || '>v</td><td' || CASE WHEN wide THEN ' title="' || s || '"' ELSE '' END || '>' || s || '</td>' || repeat('<td class="v cv"></td>', (w - 2)::int) || '</tr></tbody></table></div>' || nl
  || '<details class="hoja' || CASE WHEN hidden THEN ' oculta"' ELSE '" open' END || '><summary><h2 id="hoja-s' || s || '">Hoja: S' || s || '</h2>' || CASE WHEN hidden THEN '<span class="badge">oculta</span>' ELSE '' END
  || '<span class="stats">filas 2 · columnas con dato 3 · 0</span></summary><div class="contenido">' || nl || '<p class="meta">filas 2 · columnas con dato 3 · 0</p>' || nl || '<p><mark class="ilegible" id="m2">[ilegible]</mark></p>' || nl
  || '<h3 id="' || slug || '-3">' || name || '</h3>' || nl || '</div></details>' || nl
  || '<details class="hoja"' || CASE WHEN hidden THEN ' open' ELSE '' END || '><summary><h2 id="hoja-s' || s || '-2">Hoja: S' || s || '</h2><span class="stats">sin filas</span></summary><div class="contenido">' || nl || '<ol><li>last</li></ol>' || nl || '</div></details>' AS html
FROM t
""")
def html_view(spark, sf_dir):
    return H.rendered(_documents(spark, sf_dir)).select("doc_id", "html", "sheets", "tables", "marks")


@query(r"""
WITH p AS (SELECT p_partkey AS doc_id, p_name AS name, replace(p_name, ' ', '-') AS slug, p_size AS s FROM part)
SELECT doc_id, unnest(['1 ' || slug || ' ' || name || ' ', '2 ' || slug || '-2 ' || name || ' ', '2 hoja-s' || s || ' Hoja: S' || s || ' filas 2 · columnas con dato 3 · 0' || CASE WHEN s % 2 = 0 THEN ' oculta' ELSE '' END,
                       '3 ' || slug || '-3 ' || name || ' ', '2 hoja-s' || s || '-2 Hoja: S' || s || ' sin filas']) AS entry, unnest([1, 2, 3, 4, 5]) AS nth FROM p
""")
def view_contents(spark, sf_dir):
    toc = H.rendered(_documents(spark, sf_dir)).select("doc_id", F.posexplode("toc").alias("pos", "t"))
    entry = F.concat(F.col("t.level").cast("string"), F.lit(" "), "t.id", F.lit(" "), "t.text", F.lit(" "), "t.figures", F.when(F.col("t.hidden"), " oculta").otherwise(""))
    return toc.select("doc_id", entry.alias("entry"), (F.col("pos") + 1).alias("nth"))


@query("SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 7 = 0 THEN 'refused' WHEN p_partkey % 3 = 1 THEN 'written' ELSE 'due' END AS state FROM part")
def view_stamps(spark, sf_dir):
    """Views of an earlier run: a third are of the same content, a third of another, and some packages declare a file of that name."""
    docs, k = _documents(spark, sf_dir), F.col("doc_id")
    views = docs.filter(k % 3 > 0).select("doc_id", F.when(k % 3 == 1, H.stamp(F.col("text"))).otherwise(H.stamp(F.col("title"))).alias("stamp"))
    declared = docs.select("doc_id", F.when(k % 7 == 0, H.VIEW).otherwise("documento.md").alias("name"))
    return H.views_due(docs, views, declared).select("doc_id", "state")
