"""Pieces of SQL that several queries share."""

USABLE = "(SELECT *, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand FROM reads WHERE flag & 1796 = 0)"
SPANS = f"(SELECT read_id, sample_id, chrom, strand, pos AS start_pos, pos + CASE cigar WHEN '50M' THEN 50 WHEN '20M100N30M' THEN 150 WHEN '10S40M' THEN 40 WHEN '30M5D20M' THEN 55 ELSE 45 END AS end_pos FROM {USABLE} u)"
BLOCKS = f"(SELECT read_id, sample_id, chrom, strand, pos + o AS start_pos, pos + o + n AS end_pos FROM {USABLE} u JOIN (VALUES ('50M', 0, 50), ('20M100N30M', 0, 20), ('20M100N30M', 120, 30), ('10S40M', 0, 40), ('30M5D20M', 0, 30), ('30M5D20M', 35, 20), ('25M5I20M', 0, 25), ('25M5I20M', 25, 20)) c(cigar, o, n) ON c.cigar = u.cigar)"
DEPTH = "SELECT sample_id, chrom, strand, pos, sum(change) OVER (PARTITION BY sample_id, chrom, strand ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM (SELECT sample_id, chrom, strand, pos, sum(d) AS change FROM (SELECT sample_id, chrom, strand, start_pos AS pos, 1 AS d FROM {0} a UNION ALL SELECT sample_id, chrom, strand, end_pos, -1 FROM {0} b) e GROUP BY sample_id, chrom, strand, pos) f"
TPM = "(SELECT gene_id, sample_id, n, rpk / (sum(rpk) OVER (PARTITION BY sample_id) / 1e6) AS tpm FROM (SELECT c.gene_id, sample_id, n, n / ((end_pos - start_pos) / 1000.0) AS rpk FROM counts c JOIN genes g ON g.gene_id = c.gene_id) q)"
IMPUTED = "(SELECT variant_id, sample_id, coalesce(CAST(dosage AS DOUBLE), avg(dosage) OVER (PARTITION BY variant_id)) AS d FROM genotypes)"
CIS = "(SELECT gene_id AS phenotype_id, variant_id, pos - start_pos AS tss_distance FROM genes g JOIN variants v ON v.chrom = g.chrom AND v.pos BETWEEN g.start_pos - 50000 AND g.start_pos + 50000)"
NOMINAL = f"(SELECT p.phenotype_id, c.variant_id, tss_distance, count(*) - 2 AS dof, regr_r2(value, d) AS r2, regr_slope(value, d) AS slope, corr(value, d) AS r FROM {CIS} c JOIN phenotypes p ON p.phenotype_id = c.phenotype_id JOIN {IMPUTED} g ON g.variant_id = c.variant_id AND g.sample_id = p.sample_id GROUP BY ALL HAVING min(value) < max(value))"
STATS = "round(r2, 6) AS r2, round(CAST(CAST(slope AS FLOAT) AS DOUBLE), 6) + 0.0 AS slope, round(slope / (r * sqrt(dof / (1 - r2))), 6) AS slope_se, round(r * sqrt(dof / (1 - r2)), 6) AS tstat"
DEGREES = "(SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) e GROUP BY node)"
PREPARED = "(SELECT n.node, coalesce(b.prize, 0.0) AS prize, coalesce(b.type, 'protein') AS type, b.prize IS NOT NULL AS terminal FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) n LEFT JOIN (SELECT name, max(prize) AS prize, max(type) AS type FROM prizes GROUP BY name) b ON b.name = n.node)"
