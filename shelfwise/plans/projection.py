"""The star-schema tables projected into a store listing, in SQL that both engines read.

Placeholders in braces name the tables.  Every branch of the rules occurs: codes of all lengths,
misspelt schemes, holed paths, unreadable rates, glued suffixes, accents and odd spacing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.session import spread

LISTING = """
SELECT ((l.l_orderkey * 10 + l.l_linenumber) * 200003 + l.l_partkey) * 10007 + l.l_suppkey AS row_seq,
       'R' || CAST(((l.l_orderkey * 10 + l.l_linenumber) * 200003 + l.l_partkey) * 10007 + l.l_suppkey AS VARCHAR(20)) AS id_produit,
       l.l_suppkey AS suppkey, l.l_partkey AS partkey,
       CASE (l.l_partkey * 7 + l.l_linenumber) % 9
            WHEN 0 THEN ''
            WHEN 1 THEN CAST(100 + l.l_partkey % 900 AS VARCHAR(20))
            WHEN 2 THEN '2' || lpad(CAST((l.l_partkey * 7919) % 10000000 AS VARCHAR(20)), 7, '0')
            WHEN 3 THEN '0' || '3' || lpad(CAST((l.l_partkey * 104729) % 100000000000 AS VARCHAR(20)), 12, '0')
            WHEN 4 THEN '1' || lpad(CAST((l.l_orderkey * 7919 + 13) % 1000000000 AS VARCHAR(20)), 13, '0')
            WHEN 5 THEN '000' || lpad(CAST((l.l_partkey * 1299709) % 100000000000 AS VARCHAR(20)), 13, '0')
            WHEN 6 THEN 'X' || CAST(l.l_partkey AS VARCHAR(20))
            WHEN 7 THEN CAST(l.l_partkey * 15485863 + 11 AS VARCHAR(20))
            ELSE '3' || lpad(CAST((l.l_partkey * 32452843 + l.l_suppkey) % 100000000000 AS VARCHAR(20)), 12, '0') END AS ean,
       CASE l.l_linenumber % 4 WHEN 0 THEN upper(p.label) WHEN 1 THEN p.label WHEN 2 THEN replace(p.label, ' ', '  ') ELSE p.label || '.' END
         || CASE WHEN l.l_partkey % 17 = 3 THEN 'ORIGINE ITALIA' WHEN l.l_partkey % 17 = 5 THEN 'FAMILY SIZE' ELSE '' END AS nom,
       CASE l.l_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'htp://img.example.com/' || CAST(l.l_partkey AS VARCHAR(20)) WHEN 2 THEN 'www.example.org/' || CAST(l.l_partkey AS VARCHAR(20))
            WHEN 3 THEN 'ftp://old.example.net/' || CAST(l.l_partkey AS VARCHAR(20)) WHEN 4 THEN 'HTTP://Shop.Example.com:8080/' || CAST(l.l_partkey AS VARCHAR(20))
            ELSE 'https://img.example.com/' || CAST(l.l_partkey AS VARCHAR(20)) END AS url_image,
       CASE WHEN l.l_partkey % 10 = 9 THEN 'SANTE' WHEN l.l_partkey % 10 IN (7, 8) THEN 'NON ALIMENTAIRE' ELSE 'ALIMENTAIRE' END AS taxonomie_niveau_1,
       CASE WHEN l.l_linenumber = 5 THEN ''
            WHEN l.l_partkey % 10 = 9 THEN 'MEDICAMENTS' WHEN l.l_partkey % 10 IN (0, 1) THEN 'Boissons' WHEN l.l_partkey % 10 IN (2, 3) THEN 'FRUITS ET LEGUMES'
            WHEN l.l_partkey % 10 IN (4, 5) THEN 'ÉPICERIE SUCREE' WHEN l.l_partkey % 10 = 6 THEN 'PRODUITS FRAIS' WHEN l.l_partkey % 10 = 7 THEN 'ENTRETIEN' ELSE 'BEBE' END AS taxonomie_niveau_2,
       CASE WHEN l.l_linenumber = 6 THEN ''
            ELSE CASE l.l_partkey % 10 WHEN 0 THEN 'ALCOOLS' WHEN 1 THEN 'SODAS' WHEN 2 THEN 'LEGUMES' WHEN 3 THEN 'FRUITS' WHEN 4 THEN 'PATES A TARTINER' WHEN 5 THEN 'CAFE THE' WHEN 6 THEN 'CREMERIE'
                 WHEN 7 THEN 'LESSIVE' WHEN 8 THEN 'COUCHES' ELSE 'ANTALGIQUES' END END AS taxonomie_niveau_3,
       CASE WHEN l.l_linenumber = 7 OR l.l_partkey % 23 = 4 THEN '' WHEN l.l_partkey % 29 = 7 THEN 'AUTRES'
            ELSE CASE l.l_partkey % 10 WHEN 0 THEN 'SPIRITUEUX' WHEN 1 THEN 'COLA' WHEN 2 THEN 'TOMATES' WHEN 3 THEN 'POMMES' WHEN 4 THEN 'NOISETTE CACAO' WHEN 5 THEN 'CAFE MOULU' WHEN 6 THEN 'CREMES'
                 WHEN 7 THEN 'LIQUIDE' WHEN 8 THEN 'TAILLE 4' ELSE 'PARACETAMOL' END END AS taxonomie_niveau_4,
       CASE WHEN l.l_orderkey % 97 = 0 THEN '' WHEN l.l_orderkey % 89 = 0 THEN '33' WHEN l.l_orderkey % 83 = 0 THEN 'abc'
            WHEN l.l_tax >= 0.07 THEN '10 %'
            ELSE CASE WHEN l.l_partkey % 10 IN (0, 7, 8) THEN '20%' WHEN l.l_partkey % 10 = 9 THEN '2,1' ELSE ' 5.5' END END AS tva
FROM {lineitem} l
JOIN (SELECT p_partkey,
             CASE p_partkey % 10 WHEN 0 THEN 'Whisky écossais ' WHEN 1 THEN 'Coca Cola Zéro ' WHEN 2 THEN 'Tomates grappe ' WHEN 3 THEN 'Pommes Gala ' WHEN 4 THEN 'Nutella ' WHEN 5 THEN 'Café moulu '
                  WHEN 6 THEN 'Crème fraîche ' WHEN 7 THEN 'Lessive ' WHEN 8 THEN 'Couches ' ELSE 'Doliprane ' END
             || p_name || ' ' || CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS VARCHAR(20)) || ' CL' WHEN 1 THEN CAST(p_size AS VARCHAR(20)) || '0ML' WHEN 2 THEN '0.' || CAST(p_size AS VARCHAR(20)) || 'L'
                WHEN 3 THEN CAST(p_size AS VARCHAR(20)) || ',5 G' WHEN 4 THEN CAST(p_size AS VARCHAR(20)) || ' K' ELSE CAST(p_size AS VARCHAR(20)) || ' pcs' END AS label
      FROM {part}) p ON p.p_partkey = l.l_partkey
"""

STATUSES = """
SELECT DISTINCT CASE p_partkey % 8 WHEN 1 THEN 'https://img.example.com/' WHEN 2 THEN 'https://www.example.org/' WHEN 4 THEN 'HTTP://Shop.Example.com:8080/' ELSE 'https://img.example.com/' END || CAST(p_partkey AS VARCHAR(20)) AS url,
       p_partkey % 7 <> 0 AS ok,
       CASE WHEN p_partkey % 7 <> 0 THEN 'ok' WHEN p_partkey % 3 = 0 THEN 'dns' ELSE 'http_404' END AS reason
FROM {part} WHERE p_partkey % 8 NOT IN (0, 3) AND p_partkey % 11 <> 0
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tables(spark, sf_dir, "lineitem", "part")
    used = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax")
    return spark.sql(LISTING, lineitem=spread(read["lineitem"].select(*used), "l_orderkey", "l_linenumber"), part=read["part"])


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STATUSES, **tables(spark, sf_dir, "part"))
