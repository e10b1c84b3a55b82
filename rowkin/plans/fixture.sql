-- Rows of two customer systems derived from customer and nation. Runs unchanged in Spark and DuckDB.
-- Names are put together from syllables, the city is the nation's name, the segment and the balance
-- decide in which system a customer has rows and how many. draw columns d_* are arithmetic on keys.
people AS (
  SELECT k, nk, n_name, c_mktsegment, c_acctbal, area,
    substr('kalomirusatenoviberu', CAST(1 + 2 * (k * 7 % 1009 % 10) AS INT), 2) || substr('danelisotumarepivogi', CAST(1 + 2 * (k * 31 % 2003 % 10) AS INT), 2)
      || substr('nalaritasomodelitocu', CAST(1 + 2 * (k * 43 % 3001 % 10) AS INT), 2) AS first_low,
    CASE WHEN c_mktsegment = 'BUILDING' AND nk < 3 THEN 'sosa'
      ELSE substr('bagolemufiratipuczve', CAST(1 + 2 * (home * 17 % 4001 % 10) AS INT), 2) || substr('rrllntmbstlvrdncskgu', CAST(1 + 2 * (home * 53 % 5003 % 10) AS INT), 2)
        || substr('aedoiñezolarizumontuelé', CAST(1 + 2 * (home * 61 % 6007 % 11) AS INT), 2) END AS last_low,
    substr('vidocarapegilosatume', CAST(1 + 2 * (k * 71 % 7001 % 10) AS INT), 2) || substr('lanarosamidete', CAST(1 + 2 * (k * 13 % 811 % 7) AS INT), 2) AS second_low,
    substr(CAST(72000000 + (home * 104729 + 5) % 19999999 AS VARCHAR(20)), 1, CAST(10 - length(area) AS INT)) AS num
  FROM (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_nationkey AS BIGINT) AS nk, n_name, c_mktsegment, c_acctbal,
      -- one in eight couples of neighbouring keys is a household: one family name and one telephone
      CASE WHEN c_custkey % 16 IN (4, 5) THEN CAST(c_custkey - c_custkey % 2 AS BIGINT) ELSE CAST(c_custkey AS BIGINT) END AS home,
      CASE c_nationkey % 5 WHEN 0 THEN '11' WHEN 1 THEN '223' WHEN 2 THEN '260' WHEN 3 THEN '364' ELSE '297' END AS area
    FROM customer JOIN nation ON n_nationkey = c_nationkey) AS joined),
slots AS (
  SELECT people.*, src, cp, k * 4 + slot_no AS z FROM people
  CROSS JOIN (SELECT 'crm' AS src, 0 AS cp, 0 AS slot_no UNION ALL SELECT 'crm', 1, 1 UNION ALL SELECT 'billing', 0, 2 UNION ALL SELECT 'billing', 1, 3) AS kinds
  WHERE (src = 'crm' AND (cp = 0 OR c_acctbal < 0)) OR (src = 'billing' AND c_mktsegment <> 'MACHINERY' AND (cp = 0 OR c_acctbal > 9000))),
drawn AS (
  SELECT slots.*, (z * 263 + 11) % 9973 % 97 AS d_first, (z * 269 + 13) % 9967 % 89 AS d_last, (z * 271 + 17) % 9949 % 83 AS d_mail,
    (z * 277 + 19) % 9941 % 79 AS d_phone, (z * 281 + 23) % 9931 % 73 AS d_place, (z * 283 + 29) % 9929 % 71 AS d_birth,
    (z * 293 + 31) % 9923 % 67 AS d_time, (z * 307 + 37) % 9907 % 61 AS r_case FROM slots),
written AS (
  SELECT drawn.*,
    upper(substr(first_low, 1, 1)) || substr(CASE WHEN d_first < 10 THEN substr(first_low, 1, 4) WHEN d_first < 40 THEN replace(first_low, 'o', 'ó') ELSE first_low END, 2) AS first_out,
    upper(substr(last_low, 1, 1)) || CASE WHEN d_last < 8 THEN substr(last_low, 3) ELSE substr(last_low, 2) END
      || CASE WHEN d_last % 3 = 0 THEN ' ' || upper(substr(second_low, 1, 1)) || substr(second_low, 2) ELSE '' END AS last_out,
    replace(replace(first_low || '.' || last_low, 'ñ', 'n'), 'é', 'e') || CAST(k AS VARCHAR(20)) AS mailbox,
    CASE WHEN nk % 2 = 0 THEN 'gmail.com' ELSE 'correo.example' END AS host,
    CASE WHEN d_phone < 17 THEN reverse(num) ELSE num END AS line,
    1 + (k * 37 + CASE WHEN d_place < 7 THEN 1201 ELSE 0 END) % 4999 AS house
  FROM drawn),
w AS (
  SELECT src, (CASE WHEN src = 'crm' THEN 'C' ELSE 'B' END) || lpad(CAST(k AS VARCHAR(20)), 9, '0') || CAST(cp AS VARCHAR(20)) AS id,
    'P' || lpad(CAST(k AS VARCHAR(20)), 9, '0') AS person_id,
    CASE WHEN r_case < 9 THEN lower(first_out) ELSE first_out END AS given, CASE WHEN r_case BETWEEN 5 AND 15 THEN upper(last_out) ELSE last_out END AS family,
    CASE WHEN d_mail < 11 THEN '' WHEN d_mail < 19 THEN mailbox || '.work@' || host WHEN d_mail < 33 THEN mailbox || '+' || src || '@' || host
      WHEN d_mail < 38 THEN upper(mailbox) || '@' || host ELSE mailbox || '@' || host END AS email,
    CASE WHEN d_phone < 9 THEN '' WHEN d_phone < 11 THEN 'n/a 55' WHEN d_phone % 3 = 0 THEN '+54-9-' || area || '-' || line
      WHEN d_phone % 3 = 1 THEN '(' || area || ') 15 ' || line ELSE '9' || area || line END AS phone,
    CASE WHEN d_birth < 9 THEN '' WHEN d_birth % 2 = 0 THEN CAST(1941 + k % 61 AS VARCHAR(20)) || '-' || lpad(CAST(1 + k % 11 AS VARCHAR(20)), 2, '0') || '-' || lpad(CAST(1 + k % 27 AS VARCHAR(20)), 2, '0')
      ELSE lpad(CAST(1 + k % 27 AS VARCHAR(20)), 2, '0') || '/' || lpad(CAST(1 + k % 11 AS VARCHAR(20)), 2, '0') || '/' || CAST(1941 + k % 61 AS VARCHAR(20)) END AS birth,
    CASE WHEN d_place % 2 = 0 THEN 'Av. ' ELSE 'Avenida ' END || upper(substr(second_low, 1, 1)) || substr(second_low, 2) || ' ' || CAST(house AS VARCHAR(20))
      || CASE WHEN d_place % 7 = 3 THEN ' piso ' || CAST(1 + d_place % 9 AS VARCHAR(20)) ELSE '' END AS address,
    CASE WHEN d_time % 4 = 1 THEN lower(n_name) ELSE n_name END AS city, r_case,
    CAST(2021 + d_time % 4 AS VARCHAR(20)) || '-' || lpad(CAST(1 + d_time % 12 AS VARCHAR(20)), 2, '0') || '-' || lpad(CAST(1 + z % 28 AS VARCHAR(20)), 2, '0')
      || 'T' || lpad(CAST(z % 24 AS VARCHAR(20)), 2, '0') || ':' || lpad(CAST(k % 60 AS VARCHAR(20)), 2, '0') || ':00' AS updated_at
  FROM written)
