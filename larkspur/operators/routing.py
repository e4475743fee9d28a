"""A broker's operations by a decision table: each row says which ledger, what kind and what sign; the most specific row counts."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of assets that are fixed income.
FIXED_INCOME = ("cra", "deb", "lca", "lci", "cdb", "cdb_mp", "tesouro", "lc", "cri", "rf")

#: The operations of one exchange's statement. operation | asset (rf, other, any) | direction (Credito, Debito, any)
#: | shape (units: only a quantity, any) | ledger | kind | sign (-, +, as given).
TABLE = """
Atualização | | | | ignored | | given
TRANSFERENCIA SEM FINANCEIRO | | | | ignored | | given
TRANSFERÊNCIA SEM FINANCEIRO | | | | ignored | | given
RETIRADA DE CUSTÓDIA | | | | ignored | | given
Recibo de Subscrição | | | | ignored | | given
Solicitação de Subscrição | | | | ignored | | given
Direitos de Subscrição - Não Exercido | | | | ignored | | given
Cessão de Direitos - Solicitada | | | | ignored | | given
Direito de Subscrição | | | | ignored | | given
Transferência | | | | ignored | | given
Juros Sobre Capital Próprio - Transferido | | | | ignored | | given
Empréstimo/Aluguel de Ativos | | | | flagged | manual | given
Compra | | | | orders | C | -
Compra | rf | | | otc | aplicacao | -
Venda | | | | orders | V | +
Venda | rf | | | otc | resgate | +
Cessão de Direitos | | | | orders | V | +
Cessão de Direitos | rf | | | otc | resgate | +
Transferência - Liquidação | | | | orders | V | +
Transferência - Liquidação | | Credito | | orders | C | -
Transferência - Liquidação | rf | | | otc | resgate | +
Transferência - Liquidação | rf | Credito | | otc | aplicacao | -
COMPRA/VENDA | | | | orders | V | +
COMPRA/VENDA | | Credito | | orders | C | -
COMPRA/VENDA | rf | | | otc | resgate | +
COMPRA/VENDA | rf | Credito | | otc | aplicacao | -
COMPRA / VENDA | | | | orders | V | +
COMPRA / VENDA | | Credito | | orders | C | -
COMPRA / VENDA | rf | | | otc | resgate | +
COMPRA / VENDA | rf | Credito | | otc | aplicacao | -
COMPRA/VENDA DEFINITIVA/CESSAO | | | | orders | V | +
COMPRA/VENDA DEFINITIVA/CESSAO | | Credito | | orders | C | -
COMPRA/VENDA DEFINITIVA/CESSAO | rf | | | otc | resgate | +
COMPRA/VENDA DEFINITIVA/CESSAO | rf | Credito | | otc | aplicacao | -
Direitos de Subscrição - Exercido | | | | orders | C | -
Sobras de Subscrição | | | | orders | C | -
Leilão de Fração | | | | income | fracao | given
Fração em Ativos | | | | income | fracao | given
Dividendo | | | | income | dividendo | given
Juros Sobre Capital Próprio | | | | income | jcp | given
Rendimento | | | | income | rendimento | given
Rendimento Líquido | | | | income | rendimento | given
Bonificação em Dinheiro | | | | income | bonificacao_dinheiro | given
PAGAMENTO DE JUROS | | | | income | juros | given
PAGAMENTO DE JUROS | rf | | | otc | juros | +
PAGAMENTO DE JUROS | | Debito | | ignored | | given
PAGAMENTO DE JUROS | rf | Debito | | ignored | | given
Juros | | | | income | juros | given
Juros | rf | | | otc | juros | +
AMORTIZAÇÃO | | | | income | amortizacao | given
AMORTIZAÇÃO | rf | | | otc | amortizacao | given
AMORTIZACAO PROGRAMADA | | | | income | amortizacao | given
AMORTIZACAO PROGRAMADA | rf | | | otc | amortizacao | given
AMORTIZACAO PROGRAMADA | | Debito | | ignored | | given
AMORTIZACAO PROGRAMADA | rf | Debito | | ignored | | given
Restituição de Capital | | | | income | restituicao_capital | given
Restituição de Capital | | | units | corporate | restituicao_capital | given
APLICAÇÃO | | | | otc | aplicacao | -
RESGATE ANTECIPADO | | | | otc | resgate | +
VENCIMENTO | | | | otc | vencimento | +
Grupamento | | | | corporate | grupamento | given
Desdobramento | | | | corporate | desdobramento | given
Cisão | | | | corporate | cisao | given
Bonificação em Ativos | | | | corporate | bonificacao | given
Incorporação | | | | corporate | incorporacao | given
Conversão de Ativos | | | | corporate | conversao | given
Fusão | | | | corporate | fusao | given
"""

#: What can be asked of each condition.
DOMAIN = {"asset": ("rf", "other"), "direction": ("Credito", "Debito", "other"), "shape": ("units", "other")}


def decided(text: str = TABLE) -> list[tuple]:
    """The table with every combination of conditions spelled out, each with its most specific row. Two rows of one operation that
    fit a combination and are equally specific are an error."""
    rows = [tuple(x.strip() for x in line.split("|")) for line in text.strip().splitlines()]
    fits: dict[tuple, list[tuple]] = {}
    for operation, *asked, ledger, kind, sign in rows:
        for combination in product(*DOMAIN.values()):
            if all(a in ("", c) for a, c in zip(asked, combination)):
                fits.setdefault((operation, *combination), []).append((sum(a != "" for a in asked), ledger, kind, sign))
    out = []
    for key, found in sorted(fits.items()):
        best = max(found)
        if sum(f[0] == best[0] for f in found) > 1:
            raise ValueError(f"two rows fit {key}")
        out.append((*key, *best[1:]))
    return out


def routed(movements: DataFrame, table: str = TABLE) -> DataFrame:
    """(key, ledger, kind, value, reason) of movements (key, operation, asset_type, direction, quantity, price, value, known: whether
    the product and the institution are; null counts as known).

    Blanks around an operation and slashes at its end don't count. Ignored operations and flagged ones are such whatever the
    product; of the others, those of unknown products are 'unknown'; operations that the table lacks are flagged with their name.
    Corporate actions have no value, a missing value is 0, and the sign is what the table says. Rows without an operation go."""
    spark = movements.sparkSession
    rules = spark.createDataFrame(decided(table), "_op string, _asset string, _direction string, _shape string, ledger string, kind string, _sign string")  # twelve rows an operation
    number = lambda c: F.coalesce(F.col(c).cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))
    bare = movements.where(F.trim("operation") != "").select(
        "key", "known", F.rtrim(F.trim("operation"), F.lit("/")).alias("_op"), number("value").alias("_v"),
        F.when(F.lower(F.trim("asset_type")).isin(*FIXED_INCOME), "rf").otherwise("other").alias("_asset"),
        F.when(F.col("direction").isin("Credito", "Debito"), F.col("direction")).otherwise("other").alias("_direction"),
        F.when((number("quantity") > 0) & (number("price") == 0) & (number("value") == 0), "units").otherwise("other").alias("_shape"))
    met = bare.join(F.broadcast(rules), ["_op", "_asset", "_direction", "_shape"], "left")
    early = F.col("ledger").isin("ignored", "flagged")
    unknown = ~F.coalesce(F.col("known"), F.lit(True)) & ~F.coalesce(early, F.lit(False))
    ledger = F.when(unknown, "unknown").when(F.col("ledger").isNull(), "flagged").otherwise(F.col("ledger"))
    value = F.when(F.col("_sign") == "-", -F.abs("_v")).when(F.col("_sign") == "+", F.abs("_v")).otherwise(F.col("_v"))
    return met.select(
        "key", ledger.alias("ledger"), F.when(ledger.isin("unknown", "ignored"), "").when(F.col("ledger").isNull(), "").otherwise(F.col("kind")).alias("kind"),
        F.when(ledger.isin("orders", "income", "otc"), value).cast("double").alias("value"),
        F.when(ledger == "unknown", "unknown product or institution").when(F.col("ledger") == "flagged", F.concat(F.lit("manual: "), "_op")).when(ledger == "flagged", F.concat(F.lit("unclassified: "), "_op")).alias("reason"))
