"""False positives on neutral mentions of groups, with and without the counterfactual penalty."""

from pyspark.sql import functions as F

from weftline.llm import toxicity


def test_neutral_mentions_are_flagged_less(spark):
    """The given tables with a bias planted: a third of the toxic training rows mention one group, hardly any clean one does.
    Clean held-out texts that mention it neutrally are then flagged by the plain fit, and far less by the regularised one;
    toxic texts are still found."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    held = toxicity.held_out(F.col("doc_id"))
    mention = F.lit(" muslim")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(30))
    biased = docs.join(labels.select("doc_id", "toxic"), "doc_id", "left").withColumn("text", F.when(~held & (((F.col("toxic") == 1) & (turn < 20)) | ((F.col("toxic") == 0) & (turn < 1))), F.concat(F.coalesce("text", F.lit("")), mention)).otherwise(F.col("text"))).drop("toxic")
    fair, plain = (toxicity.train(biased, labels, fairness=f, rounds=60) for f in (3.0, 0.0))
    own = docs.join(labels, "doc_id").filter(held).select("doc_id", "text", "toxic")
    neutral = own.filter("toxic = 0").select("doc_id", F.concat(F.coalesce("text", F.lit("")), mention).alias("text"))

    def rise(model) -> float:
        """How much a mention raises the score's logit, on average over clean held-out texts."""
        logit = F.log(F.col("score") / (1 - F.col("score")))
        with_, without = (toxicity.score(x, model).select("doc_id", logit.alias(n)) for n, x in (("a", neutral), ("b", own.filter("toxic = 0").select("doc_id", "text"))))
        return with_.join(without, "doc_id").agg(F.avg(F.col("a") - F.col("b")).alias("m")).first().m

    flagged = lambda model, rows: toxicity.score(rows, model).filter("score >= 0.5").count()
    assert rise(plain) > 0.3 and rise(fair) < 0.5 * rise(plain)
    assert flagged(fair, neutral) <= flagged(plain, neutral)
    toxic = own.filter("toxic = 1").select("doc_id", "text")
    assert flagged(fair, toxic) >= 0.8 * flagged(plain, toxic)
