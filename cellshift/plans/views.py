"""Shared SQL views for checking: the same study written independently in plain SQL."""

from __future__ import annotations

from cellshift.plans.registry import view

view(
    "v_first",
    "SELECT l_orderkey AS sample_id, min(l_partkey) AS p FROM lineitem GROUP BY 1",
)
view(
    "v_samples0",
    """
SELECT o_orderkey AS sample_id, 'src' || CAST(o_custkey % 2 AS VARCHAR) AS data_source, r_name AS strain,
       p_brand AS chemical, c_mktsegment AS medium, o_orderstatus AS temperature,
       CAST(year(o_orderdate) AS BIGINT) AS pert_time, 'y' AS pert_time_unit, n_name AS plate,
       o_orderpriority AS instrument, 'W' || CAST(o_custkey % 96 AS VARCHAR) AS well,
       CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'control'
            WHEN p_brand = 'Brand#3' THEN 'quality_control' ELSE 'treatment' END AS kind
FROM orders JOIN v_first ON o_orderkey = sample_id JOIN part ON p_partkey = p
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
""",
)
view(
    "v_samples",
    """
SELECT *, CASE WHEN pert_time >= 2001 THEN 'val_time'
               WHEN chemical IN ('Brand#4', 'Brand#5') AND strain = 'ASIA' THEN 'val_both'
               WHEN chemical IN ('Brand#4', 'Brand#5') THEN 'val_chem_only'
               WHEN strain = 'ASIA' AND kind = 'treatment' THEN 'val_strain_only' ELSE 'train' END AS split,
       CASE WHEN strain = 'ASIA' THEN 'val' ELSE 'train' END AS strain_role,
       CASE WHEN chemical IN ('Brand#4', 'Brand#5') THEN 'val' ELSE 'train' END AS chemical_role,
       '#' || data_source || '-' || chemical AS pert_id,
       concat_ws(chr(31), data_source, strain, medium, temperature, CAST(pert_time AS VARCHAR)) AS match_key
FROM v_samples0
""",
)
view(
    "v_cells",
    "SELECT l_orderkey AS sample_id, 'L' || CAST(l_linenumber AS VARCHAR) AS protein, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2",
)
view("v_y", "SELECT sample_id, protein, log2(value) AS y FROM v_cells WHERE value > 0")
view("v_train", "SELECT * FROM v_samples WHERE split = 'train'")
view(
    "v_ctrl",
    "SELECT match_key, protein, avg(y) AS c, count(*) AS n_c FROM v_y JOIN v_samples USING (sample_id) WHERE kind = 'control' GROUP BY 1, 2",
)
view(
    "v_tctrl",
    "SELECT match_key, protein, avg(y) AS c FROM v_y JOIN v_train USING (sample_id) WHERE kind = 'control' GROUP BY 1, 2",
)
view("v_pm", "SELECT protein, avg(y) AS pm FROM v_y JOIN v_train USING (sample_id) GROUP BY 1")
view(
    "v_delta",
    """
SELECT s.*, y.protein, y.y, c.c, y.y - c.c AS t
FROM v_y y JOIN v_samples s USING (sample_id) JOIN v_ctrl c ON c.match_key = s.match_key AND c.protein = y.protein
WHERE s.kind = 'treatment'
""",
)
view(
    "v_tdelta",
    """
SELECT s.*, y.protein, y.y, c.c, y.y - c.c AS t
FROM v_y y JOIN v_train s USING (sample_id) JOIN v_tctrl c ON c.match_key = s.match_key AND c.protein = y.protein
WHERE s.kind = 'treatment'
""",
)
view("v_ctx", "SELECT match_key, protein, avg(t) AS ctx FROM v_tdelta GROUP BY 1, 2")
view("v_drug", "SELECT chemical, protein, avg(t) AS drug FROM v_tdelta GROUP BY 1, 2")
view(
    "v_sm",
    "SELECT strain, protein, avg(y) AS sm, count(*) AS sn FROM v_y JOIN v_train USING (sample_id) GROUP BY 1, 2",
)
view(
    "v_cm",
    "SELECT chemical, protein, avg(y) AS cm, count(*) AS cn FROM v_y JOIN v_train USING (sample_id) GROUP BY 1, 2",
)
view(
    "v_abs",
    """
SELECT s.sample_id, s.split, s.kind, s.strain, s.chemical, s.match_key, y.protein, y.y, pm AS m0,
       pm + coalesce(sn / (sn + 8.0) * (sm - pm), 0) AS m1,
       pm + coalesce(sn / (sn + 8.0) * (sm - pm), 0) + coalesce(cn / (cn + 8.0) * (cm - pm), 0) AS m2,
       pm + coalesce(sn / (sn + 1.0) * (sm - pm), 0) AS ma,
       pm + coalesce(sn / (sn + 64.0) * (sm - pm), 0) AS mb
FROM v_y y JOIN v_samples s USING (sample_id) JOIN v_pm p ON p.protein = y.protein
LEFT JOIN v_sm sm ON sm.strain = s.strain AND sm.protein = y.protein
LEFT JOIN v_cm cm ON cm.chemical = s.chemical AND cm.protein = y.protein
""",
)
view(
    "v_score",
    """
SELECT a.*, c.c, a.y - c.c AS t, ctx, drug
FROM v_abs a JOIN v_ctrl c ON c.match_key = a.match_key AND c.protein = a.protein
LEFT JOIN v_ctx x ON x.match_key = a.match_key AND x.protein = a.protein
LEFT JOIN v_drug d ON d.chemical = a.chemical AND d.protein = a.protein
WHERE a.kind = 'treatment'
""",
)
view(
    "v_cfold",
    """
SELECT chemical, CASE WHEN ((rn - 1) // 4) % 2 = 0 THEN (rn - 1) % 4 ELSE 3 - (rn - 1) % 4 END AS fold
FROM (SELECT chemical, row_number() OVER (ORDER BY n DESC, md5('101|' || chemical)) AS rn
      FROM (SELECT chemical, count(*) AS n FROM v_train WHERE kind = 'treatment' GROUP BY 1))
""",
)
view(
    "v_sfold",
    """
SELECT strain, CASE WHEN ((rn - 1) // 4) % 2 = 0 THEN (rn - 1) % 4 ELSE 3 - (rn - 1) % 4 END AS fold
FROM (SELECT strain, row_number() OVER (ORDER BY n DESC, md5('211|' || strain)) AS rn
      FROM (SELECT strain, count(*) AS n FROM v_train WHERE kind = 'treatment' GROUP BY 1))
""",
)
view(
    "v_oof",
    """
SELECT d.sample_id, f.fold, d.strain, d.chemical, d.match_key, d.protein, d.y, d.c, d.t, m.m0,
       m.m0 + coalesce(s.sn / (s.sn + 8.0) * (s.sm - m.m0), 0) AS m1, x.ctx
FROM v_tdelta d JOIN v_cfold f USING (chemical)
JOIN (SELECT k.fold, y.protein, avg(y.y) AS m0 FROM v_y y JOIN v_train t USING (sample_id)
      LEFT JOIN v_cfold cf ON cf.chemical = t.chemical CROSS JOIN (SELECT unnest(range(4)) AS fold) k
      WHERE cf.fold IS NULL OR cf.fold <> k.fold GROUP BY 1, 2) m ON m.fold = f.fold AND m.protein = d.protein
LEFT JOIN (SELECT k.fold, t.strain, y.protein, avg(y.y) AS sm, count(*) AS sn FROM v_y y JOIN v_train t USING (sample_id)
      LEFT JOIN v_cfold cf ON cf.chemical = t.chemical CROSS JOIN (SELECT unnest(range(4)) AS fold) k
      WHERE cf.fold IS NULL OR cf.fold <> k.fold GROUP BY 1, 2, 3) s
     ON s.fold = f.fold AND s.protein = d.protein AND s.strain = d.strain
LEFT JOIN (SELECT k.fold, t.match_key, t.protein, avg(t.t) AS ctx FROM v_tdelta t JOIN v_cfold cf USING (chemical)
      CROSS JOIN (SELECT unnest(range(4)) AS fold) k WHERE cf.fold <> k.fold GROUP BY 1, 2, 3) x
     ON x.fold = f.fold AND x.protein = d.protein AND x.match_key = d.match_key
""",
)
view(
    "v_creg",
    """
SELECT raw_name, number, 'chem:' || CAST(CASE WHEN number >= 8 THEN number - number % 2 ELSE number END AS VARCHAR) AS canonical_id,
       'Compound ' || CAST(CASE WHEN number >= 8 THEN number - number % 2 ELSE number END AS VARCHAR) AS canonical_name,
       mapping_status,
       CASE mapping_status WHEN 'verified' THEN 'A_verified' WHEN 'high_confidence_candidate' THEN 'C_database_lookup'
            WHEN 'proxy' THEN 'D_proxy_assumption' ELSE 'E_unresolved' END AS evidence_tier,
       CASE WHEN mapping_status = 'proxy' THEN 'chem:' || CAST(number + 100 AS VARCHAR) ELSE '' END AS proxy_target,
       CASE WHEN number IN (1, 2) THEN 'true' ELSE 'false' END AS is_control,
       CASE WHEN number = 3 THEN 'true' ELSE 'false' END AS is_quality_control,
       CASE WHEN mapping_status IN ('verified', 'high_confidence_candidate') THEN upper(substr(md5(raw_name), 1, 14)) ELSE '' END AS inchikey
FROM (SELECT raw_name, number, CASE WHEN number <= 3 THEN 'verified' WHEN number % 5 = 0 THEN 'proxy' WHEN number % 5 = 2 THEN 'high_confidence_candidate'
             WHEN number % 5 = 4 THEN 'unresolved' ELSE 'verified' END AS mapping_status
      FROM (SELECT DISTINCT p_brand AS raw_name, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS number FROM part)
      WHERE number <> 23)
""",
)
view(
    "v_sreg",
    """
SELECT r_name AS strain_code, 'strain:' || CAST(r_regionkey AS VARCHAR) AS canonical_id,
       CASE WHEN r_regionkey % 5 = 1 THEN 'high_confidence_candidate' WHEN r_regionkey % 5 = 3 THEN 'proxy' ELSE 'verified' END AS mapping_status,
       CASE WHEN r_regionkey % 5 = 3 THEN 'strain:' || CAST(r_regionkey + 10 AS VARCHAR) ELSE '' END AS proxy_target
FROM region WHERE r_regionkey <> 4
""",
)
view(
    "v_links",
    """
SELECT 'tx.P' || CAST(l_partkey AS VARCHAR) AS protein1, 'tx.S' || CAST(l_suppkey AS VARCHAR) AS protein2,
       CAST(least(1000, count(*) * 250) AS BIGINT) AS combined_score FROM lineitem GROUP BY 1, 2
""",
)
