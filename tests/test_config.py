"""Settings from a file: closed keys, types, unsafe flags."""

import pytest
from spanforge.sources import config


def _file(tmp_path, text):
    path = tmp_path / "settings.toml"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_settings_are_read_and_set(spark, tmp_path):
    path = _file(tmp_path, 'catalogue = "/media"\nallow_network = false\n[spark]\n"spark.sql.session.timeZone" = "UTC"\n')
    assert config.apply(spark, path)["catalogue"] == "/media"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


@pytest.mark.parametrize("text, message", [("colour = 1", "unknown settings: colour"), ("catalogue = 3", "wrong type: catalogue"), ("overwrite = true", "unsafe settings: overwrite")])
def test_settings_are_refused(tmp_path, text, message):
    with pytest.raises(ValueError, match=message):
        config.load(_file(tmp_path, text))
