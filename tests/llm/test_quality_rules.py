import random
import re
from collections import Counter

from docsmith.llm import quality_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if counts[w] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_against_brute_force(spark):
    rng = random.Random(7)
    texts = ["", None, "a", "a b", "a b c", "a b c a b c", "a a a a", "a a a", "x\n\n \nx\ny", "é\xa0ü 😀 ##\t$%", "\x0b\x0cw1 w2", "a b c x a b c"]
    for _ in range(120):
        texts.append("".join(rng.choices(["a", "bb", "c", " ", "\n", "\t", "  ", "#", "ü"], k=rng.randint(0, 200))))
    texts.append(" ".join(f"w{i}" for i in range(20000)))
    texts += [" ".join(f"v{i}" for i in range(60))] * 4
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    hosts, failed = Counter(), Counter()
    for i, t, s, _ in rows:
        n, chars, symbols, dup, rep = brute(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), repr(t)
        base = n < 50 or 100 * rep > 50 * n
        assert r.base_failed == base
        hosts[s] += 1
        failed[s] += base
    rates = [failed[s] / hosts[s] for s in hosts]
    m = sum(rates) / len(rates)
    v = sum((x - m) ** 2 for x in rates) / len(rates)
    h = sum(1 / n for n in hosts.values()) / len(hosts)
    q = v / (m * (1 - m)) if 0 < m < 1 else 0
    strength = min(1000.0, max(1.0, (1 - q) / (q - h))) if q - h > 1e-9 else 1000.0
    for i, _, s, _ in rows:
        rate = (failed[s] + m * strength) / (hosts[s] + strength)
        assert abs(got[i].host_rate - rate) < 1e-9
        assert got[i].kept == (not got[i].base_failed and rate <= 0.5)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality_rules.judge(df).count() == 0


def test_prior_is_found_in_small_hosts():
    """Rates of hosts with few documents vary by chance; the strength of the prior is found all the same."""
    rng = random.Random(3)
    for strength in (2.0, 8.0, 30.0):
        sizes = [rng.choice([2, 3, 5, 40]) for _ in range(60000)]
        rates = []
        for n in sizes:
            p = rng.betavariate(0.3 * strength, 0.7 * strength)
            rates.append(sum(rng.random() < p for _ in range(n)) / n)
        m = sum(rates) / len(rates)
        v = sum((x - m) ** 2 for x in rates) / len(rates)
        found = quality_rules.prior_strength(m, v, sum(1 / n for n in sizes) / len(sizes))
        assert abs(found - strength) < 0.2 * strength
    assert quality_rules.prior_strength(None, None, None) == quality_rules.prior_strength(0.0, 0.0, 1.0) == quality_rules.prior_strength(1.0, 0.0, 1.0) == 1000.0
    # one page a host says nothing of the hosts, however m and v are rounded
    for k in range(1, 100):
        m = k / 100
        assert quality_rules.prior_strength(m, m * (1 - m) * (1 + 1e-14), 1.0) == 1000.0
