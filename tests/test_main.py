"""The whole job from CSV files to report tables."""

import os

from platelens.__main__ import run
from platelens.schema import MENU_COLUMNS


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_whole_job(spark, tmp_dir):
    header = ",".join(n for n, _ in MENU_COLUMNS)
    rows = []
    for i in range(60):
        r = ["Subway", "Sonic", "Arbys"][i % 3]
        item = ['"Big Mac®"', "Fries *", '"6"" Sub"', '"Shake, Large"', "Hot Dog"][i % 5]
        nums = [str(100 + (i * 37) % 900)] + [str((i * k) % 50 + 1) for k in range(2, 15)]
        rows.append(",".join([r, item] + nums + ["No"]))
    rows.append(",".join(["Sonic", "NA"] + ["1"] * 14 + ["No"]))          # dropped at load
    _write(os.path.join(tmp_dir, "menu", "m.csv"), header + "\n" + "\n".join(rows) + "\n")
    _write(os.path.join(tmp_dir, "dict", "d.csv"), 'item,item_gr\nBig Mac,Μπιγκ Μακ\nFries,Πατάτες\n')
    _write(os.path.join(tmp_dir, "lex", "l.csv"), "word,word_tr\nHot,Ζεστό\nDog,Σκύλος\nShake,Μιλκσέικ\n")
    out = os.path.join(tmp_dir, "out")
    paths = run(spark, os.path.join(tmp_dir, "menu"), os.path.join(tmp_dir, "dict"), out,
                os.path.join(tmp_dir, "lex"), ["Subway", "Sonic"], 3, "lloyd")
    menu = spark.read.parquet(paths["menu"])
    assert menu.count() == 60
    gr = {r.item: r.item_gr for r in menu.select("item", "item_gr").distinct().collect()}
    assert gr == {"Big Mac": "Μπιγκ Μακ", "Fries": "Πατάτες", '6" Sub': '6" Sub',
                  "Shake Large": "Μιλκσέικ Large", "Hot Dog": "Ζεστό Σκύλος"}
    assert {r.category for r in menu.select("category").distinct().collect()} == {"Main", "Side", "Dessert"}
    assert spark.read.parquet(paths["max_calorie_items"]).count() == 2
    assert spark.read.parquet(paths["pca_scores"]).count() == 60
    assert sorted(os.listdir(out)) == sorted(paths)
